"""Presentations (pptx): slides, shapes, charts, restructuring, and a writer."""

from __future__ import annotations

import re

from ..functions import kernels as K
from .docx import _expand, _parts, fill as _fill, fill_image as _fill_image
from .xlsx import chart, chart_xml
from .xml import HEAD, OFFICE_NS, PACKAGE_NS, Package, children, content_types, core_properties, esc, every, find, local, package, qattr, relationships
from .xml import text as inner

P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
DIVIDER = "--- 幻灯片分隔 ---"


class Deck:
    def __init__(self, data: bytes):
        self.pkg = Package(data)
        # by file number, as slides are extracted
        found = [(int(m[1]), n) for n in self.pkg.names if (m := re.fullmatch(r"ppt/slides/slide([0-9]+)\.xml", n))]
        self.slides = [n for _, n in sorted(found)]

    def slide_text(self, k: int) -> str:
        return "\n".join(t for e in every(self.pkg.xml(self.slides[k]), "t") if (t := inner(e))).rstrip()

    def parts(self, kind: str) -> list[str]:
        """slideMasters, slideLayouts or theme parts, by name."""
        return sorted(n for n in self.pkg.names if re.fullmatch(rf"ppt/{kind}/[^/]+\.xml", n))

    def part_xml(self, kind: str, k: int) -> str | None:
        names = self.slides if kind == "slides" else self.parts(kind)
        return (self.pkg.read(names[k]) or b"").decode("utf-8") if 0 <= k < len(names) else None

    def names(self, kind: str) -> list[str | None]:
        return [(lambda e: e.get("name") if e is not None else None)(find(self.pkg.xml(n), "cSld")) for n in self.parts(kind)]

    def images(self) -> list[tuple[str, bytes]]:
        return [(n, self.pkg.read(n) or b"") for n in self.pkg.names if n.lower().startswith("ppt/media/")]

    def _shape(self, e, z: int) -> dict:
        box = next((x for x in e.iter() if local(x) == "xfrm"), None)
        off, ext = find(box, "off"), find(box, "ext")
        name = next((x for x in e.iter() if local(x) == "cNvPr"), None)
        geometry = next((x.get("prst") for x in e.iter() if local(x) == "prstGeom"), None)
        kind = {"sp": "shape", "pic": "picture", "cxnSp": "connector", "grpSp": "group", "graphicFrame": "table" if every(e, "tbl") else "chart" if every(e, "chart") else "frame"}[local(e)]
        body = [x for x in e if local(x) == "txBody"]
        return {
            "id": int(name.get("id", 0)) if name is not None else 0, "name": name.get("name") if name is not None else None, "shape_type": kind, "geometry": geometry, "z": z,
            "text": "\n".join("".join(inner(t) for t in every(p, "t")) for b in body for p in every(b, "p")),
            "left": int(off.get("x", 0)) if off is not None else 0, "top": int(off.get("y", 0)) if off is not None else 0, "width": int(ext.get("cx", 0)) if ext is not None else 0, "height": int(ext.get("cy", 0)) if ext is not None else 0,
            "rows": [["\n".join("".join(inner(t) for t in every(p, "t")) for p in every(c, "p")) for c in children(r, "tc")] for r in every(e, "tr")] if kind == "table" else None,
            "children": [self._shape(c, i) for i, c in enumerate(x for x in e if local(x) in ("sp", "pic", "cxnSp", "grpSp", "graphicFrame"))] if kind == "group" else [],
        }

    def shapes(self, k: int) -> list[dict]:
        """A slide's shapes in drawing order, with places in EMU."""
        tree = find(self.pkg.xml(self.slides[k]), "cSld", "spTree")
        items = [e for e in (tree if tree is not None else ()) if local(e) in ("sp", "pic", "cxnSp", "grpSp", "graphicFrame")]
        return [self._shape(e, z) for z, e in enumerate(items)]

    def _related(self, k: int, kind: str) -> list[str]:
        return [r["target"] for r in self.pkg.relations(self.slides[k]).values() if r["type"] == kind]

    def charts(self, k: int) -> list[dict]:
        return [{"chart_number": i + 1, **chart(root)} for i, n in enumerate(self._related(k, "chart")) if (root := self.pkg.xml(n)) is not None]

    def notes(self, k: int) -> str | None:
        for n in self._related(k, "notesSlide"):
            shapes_ = [s for s in every(self.pkg.xml(n), "sp") if any(x.get("type") == "body" for x in every(s, "ph"))]
            return "\n".join("".join(inner(t) for t in every(p, "t")) for s in shapes_ for p in every(s, "p"))
        return None

    def comments(self, k: int) -> list[dict]:
        authors = {a.get("id"): a.get("name") for a in every(self.pkg.xml("ppt/commentAuthors.xml"), "cmAuthor")}
        return [{"author": authors.get(c.get("authorId")), "text": inner(find(c, "text")), "date": c.get("dt")} for n in self._related(k, "comments") for c in every(self.pkg.xml(n), "cm")]

    def transition(self, k: int) -> str | None:
        e = next(iter(every(self.pkg.xml(self.slides[k]), "transition")), None)
        return next((local(c) for c in e), "") if e is not None else None


def text(data: bytes) -> str:
    d = Deck(data)
    return "".join((DIVIDER + "\n" if k else "") + d.slide_text(k) + "\n" for k in range(len(d.slides)))


def markdown(data: bytes) -> str | None:
    d = Deck(data)
    return "\n".join(f"## 幻灯片 {k + 1}\n\n{d.slide_text(k)}\n" for k in range(len(d.slides))) if d.slides else None


# Rectangles of the placeholders of a slide by layout, in parts of its width and height.
LAYOUTS = {
    "title": {"title": (0.1, 0.35, 0.8, 0.2), "subtitle": (0.15, 0.58, 0.7, 0.15)},
    "title_content": {"title": (0.05, 0.05, 0.9, 0.15), "body": (0.05, 0.22, 0.9, 0.7)},
    "two_content": {"title": (0.05, 0.05, 0.9, 0.15), "body": (0.05, 0.22, 0.43, 0.7), "body2": (0.52, 0.22, 0.43, 0.7)},
    "title_only": {"title": (0.05, 0.05, 0.9, 0.15)},
    "blank": {},
}


def table_row(rows: list[list[str]], cells: list[str]) -> list[list[str]]:
    """A table's rows with one more behind them."""
    return [*rows, list(cells)]


def table_without(rows: list[list[str]], index: int) -> list[list[str]]:
    """A table's rows without one; as they are where there is none at that place."""
    return [r for i, r in enumerate(rows) if i != index]


def table_column(rows: list[list[str]], index: int, header: str | None = None) -> list[list[str]]:
    """A table's rows with an empty column at a place, or behind shorter rows; header names it in the first row."""
    return [[*r[:index], (header or "") if i == 0 else "", *r[index:]] for i, r in enumerate(rows)]


class Writer:
    """Collects slides and emits the package. Places are EMU."""

    def __init__(self, width: int = 12_192_000, height: int = 6_858_000):
        self.size = (width, height)
        self.slides: list[dict] = []
        self.properties: dict[str, str] = {}
        self.layouts: list[tuple[str, str]] = []
        self.accents: list[str] = ["4472C4", "ED7D31", "A5A5A5", "FFC000", "5B9BD5", "70AD47"]

    def slide(self, layout: str = "blank", **texts: str) -> int:
        """A new slide; texts fill the layout's places by role. Returns its index."""
        self.slides.append({"shapes": [], "media": [], "charts": [], "background": None, "notes": None, "transition": None, "footer": None})
        k = len(self.slides) - 1
        w, h = self.size
        for role, (x, y, a, b) in LAYOUTS[layout].items():
            if texts.get(role) is not None:
                self.text(k, texts[role], int(x * w), int(y * h), int(a * w), int(b * h), size=32 if role == "title" else 20)
        return k

    def layout(self, name: str, kind: str = "blank") -> int:
        """A layout of the master beside its first one, which is blank. Returns its number, from 1."""
        self.layouts.append((name, kind))
        return len(self.layouts)

    def _put(self, k: int, xml: str) -> None:
        self.slides[k]["shapes"].append(xml)

    def _next(self, k: int) -> int:
        return len(self.slides[k]["shapes"]) + 2

    def _box(self, x, y, w, h, tag="a:xfrm") -> str:
        return f'<{tag}><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></{tag}>'

    def shape(self, k: int, geometry: str, x: int, y: int, w: int, h: int, text_: str = "", fill: str | None = None, size: float = 18, bold: bool = False, box: bool = False) -> None:
        n = self._next(k)
        paint = f'<a:solidFill><a:srgbClr val="{fill}"/></a:solidFill>' if fill else ""
        paragraphs = "".join(f'<a:p><a:r><a:rPr sz="{round(size * 100)}"{" b=\"1\"" if bold else ""}/><a:t>{esc(line)}</a:t></a:r></a:p>' if line else "<a:p/>" for line in text_.split("\n"))
        self._put(k, f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="{"TextBox" if box else "Shape"} {n}"/><p:cNvSpPr{" txBox=\"1\"" if box else ""}/><p:nvPr/></p:nvSpPr><p:spPr>{self._box(x, y, w, h)}<a:prstGeom prst={qattr(geometry)}><a:avLst/></a:prstGeom>{paint}</p:spPr><p:txBody><a:bodyPr wrap="square"/>{paragraphs}</p:txBody></p:sp>')

    def text(self, k: int, text_: str, x: int = 457_200, y: int = 457_200, w: int = 8_229_600, h: int = 914_400, size: float = 18, bold: bool = False) -> None:
        self.shape(k, "rect", x, y, w, h, text_, None, size, bold, box=True)

    def image(self, k: int, data: bytes, x: int = 457_200, y: int = 457_200, w: int = 3_657_600, h: int = 2_743_200, ext: str = "png") -> None:
        s, n = self.slides[k], self._next(k)
        s["media"].append((data, ext))
        self._put(k, f'<p:pic><p:nvPicPr><p:cNvPr id="{n}" name="Picture {n}"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rIdM{len(s["media"])}"/><a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr>{self._box(x, y, w, h)}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>')

    def table(self, k: int, rows: list[list], x: int = 457_200, y: int = 1_371_600, w: int = 8_229_600, h: int = 2_743_200) -> None:
        n, width = self._next(k), max((len(r) for r in rows), default=0)
        cell = lambda v: f"<a:tc><a:txBody><a:bodyPr/><a:p><a:r><a:t>{esc(K.text_of(v))}</a:t></a:r></a:p></a:txBody><a:tcPr/></a:tc>"
        body = "".join(f'<a:tr h="{h // max(1, len(rows))}">{"".join(map(cell, [*r, *[None] * (width - len(r))]))}</a:tr>' for r in rows)
        grid = "".join(f'<a:gridCol w="{w // max(1, width)}"/>' for _ in range(width))
        self._put(k, f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{n}" name="Table {n}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr>{self._box(x, y, w, h, "p:xfrm")}<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl><a:tblPr firstRow="1" bandRow="1"/><a:tblGrid>{grid}</a:tblGrid>{body}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>')

    def chart(self, k: int, chart_type: str, categories: list[str], series: dict[str, list[float]], title: str = "", x: int = 457_200, y: int = 1_371_600, w: int = 7_315_200, h: int = 4_114_800) -> None:
        s, n = self.slides[k], self._next(k)
        s["charts"].append(chart_xml({"chart_type": chart_type, "categories": categories, "series": [{"name": a, "values": v} for a, v in series.items()], "title": title}))
        c = "http://schemas.openxmlformats.org/drawingml/2006/chart"
        self._put(k, f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{n}" name="Chart {n}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr>{self._box(x, y, w, h, "p:xfrm")}<a:graphic><a:graphicData uri="{c}"><c:chart xmlns:c="{c}" r:id="rIdC{len(s["charts"])}"/></a:graphicData></a:graphic></p:graphicFrame>')

    def video(self, k: int, data: bytes, poster: bytes, x: int = 457_200, y: int = 457_200, w: int = 3_657_600, h: int = 2_743_200, ext: str = "mp4") -> None:
        """A film behind its poster picture."""
        s = self.slides[k]
        s["media"] += [(data, ext), (poster, "png")]
        n, m = self._next(k), len(s["media"])
        self._put(k, f'<p:pic><p:nvPicPr><p:cNvPr id="{n}" name="Video {n}"/><p:cNvPicPr/><p:nvPr><a:videoFile r:link="rIdM{m - 1}"/></p:nvPr></p:nvPicPr><p:blipFill><a:blip r:embed="rIdM{m}"/><a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr>{self._box(x, y, w, h)}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>')

    def ungroup(self, k: int, shape: int) -> None:
        """A group's shapes in its place."""
        s = self.slides[k]["shapes"]
        m = re.fullmatch(r"<p:grpSp><p:nvGrpSpPr>.*?</p:nvGrpSpPr><p:grpSpPr/>(.*)</p:grpSp>", s[shape], re.DOTALL)
        if m:
            s[shape : shape + 1] = re.findall(r"<p:(?:sp|pic|graphicFrame|cxnSp)>.*?</p:(?:sp|pic|graphicFrame|cxnSp)>", m[1], re.DOTALL)

    def group(self, k: int, first: int, last: int) -> None:
        """Shapes first to last (inclusive) become one group."""
        s = self.slides[k]["shapes"]
        s[first : last + 1] = [f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="{900 + first}" name="Group"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{"".join(s[first : last + 1])}</p:grpSp>']

    def reorder(self, k: int, shape: int, to: str) -> None:
        """A shape to the front or back, or one step forward or backward."""
        s = self.slides[k]["shapes"]
        x = s.pop(shape)
        s.insert({"front": len(s), "back": 0, "forward": min(len(s), shape + 1), "backward": max(0, shape - 1)}[to], x)

    def save(self) -> bytes:
        ns = f'xmlns:a="{A}" xmlns:p="{P}" xmlns:r="{OFFICE_NS}/relationships"'
        base = "application/vnd.openxmlformats-officedocument.presentationml."
        parts: dict[str, str | bytes] = {}
        types = {"ppt/presentation.xml": base + "presentation.main+xml", "ppt/slideMasters/slideMaster1.xml": base + "slideMaster+xml", "ppt/slideLayouts/slideLayout1.xml": base + "slideLayout+xml", "ppt/theme/theme1.xml": "application/vnd.openxmlformats-officedocument.theme+xml", "docProps/core.xml": "application/vnd.openxmlformats-package.core-properties+xml"}
        empty = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
        for k, s in enumerate(self.slides, 1):
            rels = [("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")]
            for i, (data, ext) in enumerate(s["media"], 1):
                parts[f"ppt/media/image{k}_{i}.{ext}"] = data
                rels.append((f"rIdM{i}", "image", f"../media/image{k}_{i}.{ext}"))
            for i, xml in enumerate(s["charts"], 1):
                parts[f"ppt/charts/chart{k}_{i}.xml"] = xml
                types[f"ppt/charts/chart{k}_{i}.xml"] = "application/vnd.openxmlformats-officedocument.drawingml.chart+xml"
                rels.append((f"rIdC{i}", "chart", f"../charts/chart{k}_{i}.xml"))
            if s["notes"] is not None:
                parts[f"ppt/notesSlides/notesSlide{k}.xml"] = f'{HEAD}<p:notes {ns}><p:cSld><p:spTree>{empty}<p:sp><p:nvSpPr><p:cNvPr id="2" name="Notes"/><p:cNvSpPr/><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>' + "".join(f"<a:p><a:r><a:t>{esc(x)}</a:t></a:r></a:p>" for x in s["notes"].split("\n")) + "</p:txBody></p:sp></p:spTree></p:cSld></p:notes>"
                types[f"ppt/notesSlides/notesSlide{k}.xml"] = base + "notesSlide+xml"
                rels.append(("rIdN", "notesSlide", f"../notesSlides/notesSlide{k}.xml"))
            bg = f'<p:bg><p:bgPr><a:solidFill><a:srgbClr val="{s["background"]}"/></a:solidFill><a:effectLst/></p:bgPr></p:bg>' if s["background"] else ""
            foot = f'<p:sp><p:nvSpPr><p:cNvPr id="990" name="Footer"/><p:cNvSpPr/><p:nvPr><p:ph type="ftr" idx="11"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/><a:p><a:r><a:t>{esc(s["footer"])}</a:t></a:r></a:p></p:txBody></p:sp>' if s["footer"] else ""
            move = f"<p:transition><p:{s['transition']}/></p:transition>" if s["transition"] else ""
            parts[f"ppt/slides/slide{k}.xml"] = f'{HEAD}<p:sld {ns}><p:cSld>{bg}<p:spTree>{empty}{"".join(s["shapes"])}{foot}</p:spTree></p:cSld>{move}</p:sld>'
            types[f"ppt/slides/slide{k}.xml"] = base + "slide+xml"
            parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = relationships(rels)
        n = len(self.slides)
        listed = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k + 1}"/>' for k in range(1, n + 1))
        w, h = self.size
        parts["ppt/presentation.xml"] = f'{HEAD}<p:presentation {ns}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{listed}</p:sldIdLst><p:sldSz cx="{w}" cy="{h}"/><p:notesSz cx="{h}" cy="{w}"/></p:presentation>'
        parts["ppt/_rels/presentation.xml.rels"] = relationships([("rId1", "slideMaster", "slideMasters/slideMaster1.xml"), *((f"rId{k + 1}", "slide", f"slides/slide{k}.xml") for k in range(1, n + 1)), (f"rId{n + 2}", "theme", "theme/theme1.xml")])
        clr = 'bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"'
        own = [("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), *((f"rIdL{i}", "slideLayout", f"../slideLayouts/slideLayout{i}.xml") for i in range(2, len(self.layouts) + 2))]
        for i, (name, kind) in enumerate(self.layouts, 2):
            parts[f"ppt/slideLayouts/slideLayout{i}.xml"] = f'{HEAD}<p:sldLayout {ns} type={qattr(kind)}><p:cSld name={qattr(name)}><p:spTree>{empty}</p:spTree></p:cSld></p:sldLayout>'
            parts[f"ppt/slideLayouts/_rels/slideLayout{i}.xml.rels"] = relationships([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")])
            types[f"ppt/slideLayouts/slideLayout{i}.xml"] = base + "slideLayout+xml"
        parts["ppt/slideMasters/slideMaster1.xml"] = f'{HEAD}<p:sldMaster {ns}><p:cSld name="Master"><p:spTree>{empty}</p:spTree></p:cSld><p:clrMap {clr}/><p:sldLayoutIdLst>{"".join(f'<p:sldLayoutId id="{2147483649 + i}" r:id="{r}"/>' for i, (r, *_) in enumerate(own))}</p:sldLayoutIdLst></p:sldMaster>'
        parts["ppt/slideMasters/_rels/slideMaster1.xml.rels"] = relationships([*own, ("rId2", "theme", "../theme/theme1.xml")])
        parts["ppt/slideLayouts/slideLayout1.xml"] = f'{HEAD}<p:sldLayout {ns}><p:cSld name="Blank"><p:spTree>{empty}</p:spTree></p:cSld></p:sldLayout>'
        parts["ppt/slideLayouts/_rels/slideLayout1.xml.rels"] = relationships([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")])
        scheme = "".join(f'<a:{t}><a:srgbClr val="{c}"/></a:{t}>' for t, c in (("dk1", "000000"), ("lt1", "FFFFFF"), ("dk2", "44546A"), ("lt2", "E7E6E6"), *((f"accent{i}", c) for i, c in enumerate(self.accents, 1)), ("hlink", "0563C1"), ("folHlink", "954F72")))
        solid = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
        fonts = "".join(f'<a:{t}><a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/></a:{t}>' for t in ("majorFont", "minorFont"))
        parts["ppt/theme/theme1.xml"] = f'{HEAD}<a:theme xmlns:a="{A}" name="Theme"><a:themeElements><a:clrScheme name="Office">{scheme}</a:clrScheme><a:fontScheme name="Office">{fonts}</a:fontScheme><a:fmtScheme name="Office"><a:fillStyleLst>{solid * 3}</a:fillStyleLst><a:lnStyleLst>{f"<a:ln>{solid}</a:ln>" * 3}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{solid * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
        parts["docProps/core.xml"] = core_properties(self.properties)
        parts["_rels/.rels"] = relationships([("rId1", "officeDocument", "ppt/presentation.xml"), ("rId2", f"{PACKAGE_NS}/relationships/metadata/core-properties", "docProps/core.xml")])
        return package({"[Content_Types].xml": content_types(types, {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "mp4": "video/mp4"}), **parts})


def arranged(data: bytes, order: list[int]) -> bytes:
    """The deck with these slides in this order: removes, moves and clones. Parts that no slide names stay."""
    d, parts = Deck(data), _parts(data)
    old = d.slides
    kept = [(parts[old[k]], parts.get(old[k].replace("slides/", "slides/_rels/") + ".rels", b"")) for k in order]
    for n in old:
        parts.pop(n)
        parts.pop(n.replace("slides/", "slides/_rels/") + ".rels", None)
    types = re.sub(r'<Override PartName="/ppt/slides/slide[0-9]+\.xml"[^>]*/>', "", parts["[Content_Types].xml"].decode())
    rels = re.sub(r'<Relationship [^>]*relationships/slide"[^>]*/>', "", parts["ppt/_rels/presentation.xml.rels"].decode())
    listed = added = ""
    for k, (xml, rel) in enumerate(kept, 1):
        parts[f"ppt/slides/slide{k}.xml"] = xml
        if rel:
            parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = rel
        types = types.replace("</Types>", f'<Override PartName="/ppt/slides/slide{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.presentationml.slide+xml"/></Types>')
        added += f'<Relationship Id="rIdS{k}" Type="{OFFICE_NS}/relationships/slide" Target="slides/slide{k}.xml"/>'
        listed += f'<p:sldId id="{255 + k}" r:id="rIdS{k}"/>'
    parts["[Content_Types].xml"] = types.encode()
    parts["ppt/_rels/presentation.xml.rels"] = rels.replace("</Relationships>", added + "</Relationships>").encode()
    deck = parts["ppt/presentation.xml"].decode()
    deck = re.sub(r"<p:sldIdLst>.*?</p:sldIdLst>|<p:sldIdLst/>", f"<p:sldIdLst>{listed}</p:sldIdLst>", deck, flags=re.DOTALL)
    parts["ppt/presentation.xml"] = deck.encode()
    return package(parts)


def merged(decks: list[bytes]) -> bytes | None:
    """All slides behind each other, by deck and slide number; masters of the first. None of none, one as it is."""
    if len(decks) < 2:
        return decks[0] if decks else None
    out = _parts(decks[0])
    count = len(Deck(decks[0]).slides)
    for j, data in enumerate(decks[1:], 2):
        d, parts = Deck(data), _parts(data)
        own = {n: n.replace("ppt/media/", f"ppt/media/d{j}_").replace("ppt/charts/", f"ppt/charts/d{j}_") for n in parts if n.startswith(("ppt/media/", "ppt/charts/"))}
        out |= {new: parts[n] for n, new in own.items()}
        types = parts["[Content_Types].xml"].decode()
        for n, new in own.items():
            if m := re.search(rf'<Override PartName="/{re.escape(n)}" ContentType="([^"]+)"', types):
                out["[Content_Types].xml"] = out["[Content_Types].xml"].replace(b"</Types>", f'<Override PartName="/{new}" ContentType="{m[1]}"/></Types>'.encode())
        for n in d.slides:
            count += 1
            rel = parts.get(n.replace("slides/", "slides/_rels/") + ".rels", b"").decode()
            rel = re.sub(r'<Relationship [^>]*relationships/(?:notesSlide|comments)"[^>]*/>', "", rel).replace("../media/", f"../media/d{j}_").replace("../charts/", f"../charts/d{j}_")
            out[f"ppt/slides/slide{count}.xml"] = parts[n]
            out[f"ppt/slides/_rels/slide{count}.xml.rels"] = re.sub(r"slideLayout[0-9]+\.xml", "slideLayout1.xml", rel).encode()
    return arranged(package(out), list(range(count)))


def fill(data: bytes, values: dict[str, str | None]) -> bytes:
    return _fill(data, values)


def fill_table(data: bytes, slide: int, name: str, items: list[dict]) -> bytes:
    parts, n = _parts(data), Deck(data).slides[slide]
    parts[n] = _expand(parts[n].decode("utf-8"), name, items, "a:tr").encode()
    return package(parts)


def fill_image(data: bytes, slide: int, placeholder: str, image: bytes) -> bytes:
    return _fill_image(data, placeholder, image, part=Deck(data).slides[slide])




def _targets(data: bytes, slide: int, kind: str) -> list[str]:
    d = Deck(data)
    return [r["target"] for r in d.pkg.relations(d.slides[slide]).values() if r["type"] == kind]


def replace_image(data: bytes, slide: int, number: int, image: bytes) -> bytes:
    """The slide's picture with that number (from 0) replaced."""
    parts = _parts(data)
    parts[_targets(data, slide, "image")[number]] = image
    return package(parts)


def update_chart(data: bytes, slide: int, number: int, categories: list[str], series: dict[str, list[float]]) -> bytes:
    """The slide's chart with that number (from 0) drawn anew from other data."""
    parts = _parts(data)
    target = _targets(data, slide, "chart")[number]
    old = Deck(data).charts(slide)[number]
    parts[target] = chart_xml({"chart_type": old["chart_type"], "categories": categories, "series": [{"name": n, "values": v} for n, v in series.items()]}).encode()
    return package(parts)


def duplicate_shape(data: bytes, slide: int, number: int, dx: int = 190_500, dy: int = 190_500) -> bytes:
    """The slide's shape with that number (from 0) once more, in front of it and moved."""
    parts, name = _parts(data), Deck(data).slides[slide]
    xml = parts[name].decode("utf-8")
    found = list(re.finditer(r"<p:(sp|pic|graphicFrame|cxnSp)>.*?</p:\1>", xml, re.DOTALL))
    one = found[number]
    moved = re.sub(r'<a:off x="(-?[0-9]+)" y="(-?[0-9]+)"/>', lambda m: f'<a:off x="{int(m[1]) + dx}" y="{int(m[2]) + dy}"/>', one[0], count=1)
    ids = max(int(i) for i in re.findall(r'<p:cNvPr id="([0-9]+)"', xml)) + 1
    moved = re.sub(r'(<p:cNvPr id=")[0-9]+"', rf'\g<1>{ids}"', moved, count=1)
    parts[name] = (xml[: one.end()] + moved + xml[one.end() :]).encode()
    return package(parts)
