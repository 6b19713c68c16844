"""Word documents (docx): blocks, tables, templates, HTML, and a writer."""

from __future__ import annotations

import base64
import re
from html import escape as html_escape

from ..functions import kernels as K
from .xml import HEAD, OFFICE_NS, Package, attr, children, content_types, core_properties, esc, every, find, local, package, parse as parse_xml, qattr, read_core, relationships


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def run_text(r) -> str:
    out = []
    for e in r:
        n = local(e)
        if n in ("t", "delText"):
            out.append(e.text or "")
        elif n == "tab":
            out.append("\t")
        elif n in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def paragraph_text(p) -> str:
    return "".join(run_text(r) for r in every(p, "r"))


class Document:
    def __init__(self, data: bytes):
        self.pkg = Package(data)
        self.path = next((r["target"] for r in self.pkg.relations("").values() if r["type"] == "officeDocument"), "word/document.xml")
        self.root = self.pkg.xml(self.path)
        self.body = find(self.root, "body")
        self.rels = self.pkg.relations(self.path)

    def paragraphs(self) -> list[str]:
        """Texts of all paragraphs in document order, those of cells too; empty ones dropped."""
        return [t for p in every(self.body, "p") if (t := paragraph_text(p))]

    def tables(self) -> list[list[list[str]]]:
        """Texts of all tables; a nested one also stands for itself. Empty rows and tables dropped."""
        out = []
        for t in every(self.body, "tbl"):
            rows = [[("\n".join(paragraph_text(p) for p in every(c, "p"))).strip() for c in children(r, "tc")] for r in children(t, "tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                out.append(rows)
        return out

    def images(self) -> list[tuple[str, bytes]]:
        return [(n, self.pkg.read(n) or b"") for n in self.pkg.names if n.lower().startswith("word/media/")]

    def properties(self) -> dict[str, str]:
        return read_core(self.pkg)

    def _run(self, r, link: str | None) -> dict:
        style = find(r, "rPr")
        on = lambda n: (e := find(style, n)) is not None and attr(e, "val") not in ("0", "false", "none")
        color, size = find(style, "color"), find(style, "sz")
        pictures = [self.rels.get(attr(b, "embed") or "", {}).get("target") for b in every(r, "blip")]
        return {"text": run_text(r), "bold": on("b"), "italic": on("i"), "underline": on("u"), "strike": on("strike"), "color": attr(color, "val") if color is not None else None, "size": int(attr(size, "val") or 0) / 2 if size is not None else None, "link": link, "image": next(iter(pictures), None)}

    def _paragraph(self, p) -> dict:
        style = find(p, "pPr")
        val = lambda *path: (lambda e: attr(e, "val") if e is not None else None)(find(style, *path))
        runs = []
        for e in p:
            if local(e) == "r":
                runs.append(self._run(e, None))
            elif local(e) == "hyperlink":
                url = self.rels.get(attr(e, "id") or "", {}).get("target") or ("#" + attr(e, "anchor") if attr(e, "anchor") else None)
                runs += [self._run(r, url) for r in children(e, "r")]
            elif local(e) in ("ins", "smartTag", "sdt", "fldSimple"):
                runs += [self._run(r, None) for r in every(e, "r")]
        name = val("pStyle")
        return {"kind": "paragraph", "style": name, "level": heading_level(name), "align": val("jc"), "list": val("numPr", "numId"), "list_level": int(val("numPr", "ilvl") or 0), "runs": runs, "text": "".join(r["text"] for r in runs), "page_break": any(attr(b, "type") == "page" for b in every(p, "br"))}

    def blocks(self, at=None) -> list[dict]:
        """Paragraphs, tables (with the blocks of their cells), and content controls, in order."""
        out: list[dict] = []
        for e in self.body if at is None else at:
            if local(e) == "p":
                out.append(self._paragraph(e))
            elif local(e) == "tbl":
                rows = [[{"span": int(attr(s, "val") or 1) if (s := find(c, "tcPr", "gridSpan")) is not None else 1, "blocks": self.blocks(c)} for c in children(r, "tc")] for r in children(e, "tr")]
                out.append({"kind": "table", "rows": rows})
            elif local(e) == "sdt":
                alias = find(e, "sdtPr", "alias")
                out.append({"kind": "control", "alias": attr(alias, "val") if alias is not None else None, "blocks": self.blocks(find(e, "sdtContent") if find(e, "sdtContent") is not None else ())})
        return out

    def headers(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {"header": [], "footer": []}
        for r in self.rels.values():
            if r["type"] in out and (root := self.pkg.xml(r["target"])) is not None:
                out[r["type"]].append("\n".join(t for p in every(root, "p") if (t := paragraph_text(p))))
        return out

    def notes(self) -> dict[str, list[str]]:
        """Texts of footnotes and endnotes; separators, which have a type, aren't notes."""
        out: dict[str, list[str]] = {"footnote": [], "endnote": []}
        for r in self.rels.values():
            kind = r["type"].removesuffix("s")
            if kind in out and (root := self.pkg.xml(r["target"])) is not None:
                out[kind] += ["\n".join(paragraph_text(p) for p in every(n, "p")) for n in every(root, kind) if attr(n, "type") in (None, "normal")]
        return out


def plain(block: dict) -> str:
    """A block's text; cells are set apart by tabs, rows and blocks by line feeds."""
    if block["kind"] == "table":
        return "\n".join("\t".join("\n".join(map(plain, c["blocks"])) for c in r) for r in block["rows"])
    return "\n".join(map(plain, block["blocks"])) if block["kind"] == "control" else block["text"]


def heading_level(style: str | None) -> int:
    """1 to 6 of a heading style's id, else 0."""
    m = re.fullmatch(r"(?i)(?:heading|标题)\s*([1-9])|([1-9])", style or "")
    return min(6, int(m[1] or m[2])) if m else 0


def text(data: bytes) -> str:
    return "\n".join(Document(data).paragraphs())


def markdown(data: bytes) -> str:
    """All paragraphs, then all tables, so that a cell's text stands twice."""
    d = Document(data)
    out = [x for p in d.paragraphs() for x in (p, "")]
    for t in d.tables():
        out += [*K.md_table(t), ""]
    return "".join(line + "\n" for line in out)


def html(data: bytes, title: str = "", images: bool = False) -> str:
    """Headings, alignment, run styles, links, tables with a head row, and images as data where asked for."""
    d = Document(data)

    def runs(p: dict) -> str:
        out = ""
        for r in p["runs"]:
            s = html_escape(r["text"], quote=False).replace("\n", "<br/>")
            if images and r["image"] and (raw := d.pkg.read(r["image"])):
                s += f'<img src="data:image/{r["image"].rpartition(".")[2]};base64,{base64.b64encode(raw).decode()}" alt=""/>'
            for key, tag in (("strike", "s"), ("underline", "u"), ("italic", "em"), ("bold", "strong")):
                s = f"<{tag}>{s}</{tag}>" if r[key] and s else s
            css = (f"color:#{r['color']};" if r["color"] and r["color"] != "auto" else "") + (f"font-size:{r['size']:g}pt;" if r["size"] else "")
            s = f'<span style="{css}">{s}</span>' if css and s else s
            out += f'<a href="{html_escape(r["link"])}">{s}</a>' if r["link"] else s
        return out

    def one(b: dict) -> str:
        if b["kind"] == "control":
            return "".join(map(one, b["blocks"]))
        if b["kind"] == "table":
            body = ""
            for i, r in enumerate(b["rows"]):
                tag = "td" if i else "th"
                body += "<tr>" + "".join(f"<{tag}{f' colspan=\"{c["span"]}\"' if c['span'] > 1 else ''}>{'<br/>'.join(runs(x) for x in c['blocks'] if x['kind'] == 'paragraph')}</{tag}>" for c in r) + "</tr>\n"
            return f"<table>\n{body}</table>\n"
        tag = f"h{b['level']}" if b["level"] else "p"
        align = f' style="text-align:{ {"both": "justify", "start": "left", "end": "right"}.get(b["align"], b["align"])}"' if b["align"] else ""
        return f"<{tag}{align}>{runs(b)}</{tag}>\n"

    return f'<!DOCTYPE html>\n<html>\n<head><meta charset="utf-8"/><title>{html_escape(title)}</title></head>\n<body>\n{"".join(map(one, d.blocks()))}</body>\n</html>\n'


SIDES = ("top", "left", "bottom", "right", "insideH", "insideV")


def borders(style: str = "single", color: str | None = None, width: int = 4, inside: bool = True) -> dict[str, dict]:
    """Lines of a table's sides: one for all, or with inside False for the outline alone. width: eighths of a point."""
    line = {"style": style, "color": color, "width": width}
    return {s: line if inside or not s.startswith("inside") else {"style": "none"} for s in SIDES}


class Writer:
    """Collects blocks and emits the package."""

    def __init__(self):
        self.body: list[str] = []
        self.rels: list[tuple] = [("rId1", "styles", "styles.xml"), ("rId2", "numbering", "numbering.xml")]
        self.media: dict[str, bytes] = {}
        self.properties: dict[str, str] = {}
        self.bookmarks = 0
        self.footnotes: list[str] = []
        self.section = {"width": 11906, "height": 16838, "margin": 1440, "header": None, "footer": None}

    def _rel(self, kind: str, target: str, external: bool = False) -> str:
        self.rels.append((f"rId{len(self.rels) + 1}", kind, target, external))
        return self.rels[-1][0]

    @staticmethod
    def run(text_: str, bold=False, italic=False, underline=False, strike=False, color: str | None = None, size: float | None = None, style: str | None = None) -> str:
        p = (f"<w:rStyle w:val={qattr(style)}/>" if style else "") + "<w:b/>" * bool(bold) + "<w:i/>" * bool(italic) + "<w:strike/>" * bool(strike) + (f'<w:color w:val="{color}"/>' if color else "") + (f'<w:sz w:val="{round(size * 2)}"/>' if size else "") + '<w:u w:val="single"/>' * bool(underline)
        parts = []
        for k, line in enumerate(text_.split("\n")):
            cells = line.split("\t")
            parts.append(("<w:br/>" if k else "") + "<w:tab/>".join(f'<w:t xml:space="preserve">{esc(c)}</w:t>' for c in cells))
        return f"<w:r>{f'<w:rPr>{p}</w:rPr>' if p else ''}{''.join(parts)}</w:r>"

    def paragraph(self, content: str | list[dict] = "", style: str | None = None, align: str | None = None, num: tuple[int, int] | None = None) -> Writer:
        """content: a text, or runs with text and styles."""
        runs = self.run(content) if isinstance(content, str) else "".join(self.run(**{("text_" if k == "text" else k): v for k, v in r.items()}) for r in content)
        self._raw(runs, style, align, num)
        return self

    def _raw(self, runs: str, style: str | None = None, align: str | None = None, num: tuple[int, int] | None = None) -> None:
        p = (f"<w:pStyle w:val={qattr(style)}/>" if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "") + (f"<w:jc w:val={qattr(align)}/>" if align else "")
        self.body.append(f"<w:p>{f'<w:pPr>{p}</w:pPr>' if p else ''}{runs}</w:p>")

    def heading(self, text_: str, level: int = 1) -> Writer:
        return self.paragraph(text_, style=f"Heading{max(1, min(6, level))}")

    def bullets(self, items: list[str], level: int = 0, ordered: bool = False) -> Writer:
        for i in items:
            self.paragraph(i, num=(2 if ordered else 1, level))
        return self

    def multilevel(self, items: list[tuple[int, str]]) -> Writer:
        for level, i in items:
            self.paragraph(i, num=(1, level))
        return self

    def hyperlink(self, text_: str, url: str) -> Writer:
        at = f"w:anchor={qattr(url[1:])}" if url.startswith("#") else f'r:id="{self._rel("hyperlink", url, True)}"'
        self._raw(f"<w:hyperlink {at}>{self.run(text_, underline=True, color='0563C1')}</w:hyperlink>")
        return self

    def footnote(self, text_: str, note: str) -> Writer:
        """A paragraph with a note at its end."""
        self.footnotes.append(note)
        self._raw(f'{self.run(text_)}<w:r><w:footnoteReference w:id="{len(self.footnotes)}"/></w:r>')
        return self

    def bookmark(self, text_: str, name: str) -> Writer:
        self.bookmarks += 1
        self._raw(f'<w:bookmarkStart w:id="{self.bookmarks}" w:name={qattr(name)}/>{self.run(text_)}<w:bookmarkEnd w:id="{self.bookmarks}"/>')
        return self

    def _field(self, instruction: str, shown: str) -> str:
        mark = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
        return f'{mark("begin")}<w:r><w:instrText xml:space="preserve"> {esc(instruction)} </w:instrText></w:r>{mark("separate")}{self.run(shown)}{mark("end")}'

    def cross_reference(self, name: str, shown: str) -> Writer:
        self._raw(self._field(f"REF {name} \\h", shown))
        return self

    def merge_field(self, name: str, before: str = "", after: str = "") -> Writer:
        self._raw((self.run(before) if before else "") + self._field(f"MERGEFIELD {name}", f"«{name}»") + (self.run(after) if after else ""))
        return self

    def page_break(self) -> Writer:
        self._raw('<w:r><w:br w:type="page"/></w:r>')
        return self

    def rule(self) -> Writer:
        self.body.append('<w:p><w:pPr><w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr></w:pPr></w:p>')
        return self

    def control(self, kind: str, value: str = "", alias: str = "", items: list[str] = ()) -> Writer:
        """A content control: text, richText, date, dropDownList or comboBox."""
        listed = "".join(f"<w:listItem w:displayText={qattr(i)} w:value={qattr(i)}/>" for i in items)
        own = f"<w:{kind}>{listed}</w:{kind}>" if listed else f"<w:{kind}/>"
        self.body.append(f"<w:sdt><w:sdtPr><w:alias w:val={qattr(alias)}/>{own}</w:sdtPr><w:sdtContent><w:p>{self.run(value)}</w:p></w:sdtContent></w:sdt>")
        return self

    def table(self, rows: list[list], header: bool = True, lines: dict[str, dict] | None = None) -> Writer:
        """lines: by side, as borders() makes them; all sides by default."""
        width = max((len(r) for r in rows), default=0)
        lines = borders() if lines is None else lines
        edge = "".join(f'<w:{s} w:val="{lines[s].get("style", "single")}" w:sz="{lines[s].get("width", 4)}" w:space="0" w:color="{lines[s].get("color") or "auto"}"/>' for s in SIDES if s in lines)
        body = ""
        for k, r in enumerate(rows):
            cells = "".join(f"<w:tc><w:tcPr/><w:p>{self.run(K.text_of(v), bold=header and k == 0)}</w:p></w:tc>" for v in [*r, *[None] * (width - len(r))])
            body += f"<w:tr>{cells}</w:tr>"
        self.body.append(f"<w:tbl><w:tblPr><w:tblW w:w=\"0\" w:type=\"auto\"/><w:tblBorders>{edge}</w:tblBorders></w:tblPr><w:tblGrid>{'<w:gridCol/>' * width}</w:tblGrid>{body}</w:tbl>")
        return self

    def image(self, data: bytes, width_cm: float = 10, height_cm: float = 7, ext: str = "png") -> Writer:
        name = f"media/image{len(self.media) + 1}.{ext}"
        self.media[name] = data
        rid = self._rel("image", name)
        cx, cy = K.cm_to_emu(width_cm), K.cm_to_emu(height_cm)
        k = len(self.media)
        a, pic = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/picture"
        self._raw(
            f'<w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{k}" name="Picture {k}"/><a:graphic xmlns:a="{a}"><a:graphicData uri="{pic}"><pic:pic xmlns:pic="{pic}"><pic:nvPicPr><pic:cNvPr id="{k}" name="image{k}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{rid}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
        )
        return self

    def append(self, data: bytes) -> Writer:
        """The blocks of another document, as texts and tables."""
        for b in Document(data).blocks():
            if b["kind"] == "table":
                self.table([["\n".join(x.get("text", "") for x in c["blocks"]) for c in r] for r in b["rows"]])
            elif b["kind"] == "paragraph":
                keep = ("text", "bold", "italic", "underline", "strike", "color", "size")
                self.paragraph([{k: r[k] for k in keep} for r in b["runs"]], style=b["style"], align=b["align"])
        return self

    def save(self) -> bytes:
        parts: dict[str, str | bytes] = {}
        word = "application/vnd.openxmlformats-officedocument.wordprocessingml."
        types = {"word/document.xml": word + "document.main+xml", "word/styles.xml": word + "styles+xml", "word/numbering.xml": word + "numbering+xml", "docProps/core.xml": "application/vnd.openxmlformats-package.core-properties+xml"}
        refs = ""
        for kind in ("header", "footer"):
            if self.section[kind]:
                rid = self._rel(kind, f"{kind}1.xml")
                tag = "hdr" if kind == "header" else "ftr"
                parts[f"word/{kind}1.xml"] = f'{HEAD}<w:{tag} xmlns:w="{W}"><w:p>{self.run(self.section[kind])}</w:p></w:{tag}>'
                types[f"word/{kind}1.xml"] = word + f"{kind}+xml"
                refs += f'<w:{kind}Reference w:type="default" r:id="{rid}"/>'
        if self.footnotes:
            self._rel("footnotes", "footnotes.xml")
            notes = "".join(f'<w:footnote w:id="{k}"><w:p>{self.run(t)}</w:p></w:footnote>' for k, t in enumerate(self.footnotes, 1))
            parts["word/footnotes.xml"] = f'{HEAD}<w:footnotes xmlns:w="{W}"><w:footnote w:type="separator" w:id="0"><w:p><w:r><w:separator/></w:r></w:p></w:footnote>{notes}</w:footnotes>'
            types["word/footnotes.xml"] = word + "footnotes+xml"
        s = self.section
        m = s["margin"]
        section = f'<w:sectPr>{refs}<w:pgSz w:w="{s["width"]}" w:h="{s["height"]}"/><w:pgMar w:top="{m}" w:right="{m}" w:bottom="{m}" w:left="{m}" w:header="720" w:footer="720" w:gutter="0"/></w:sectPr>'
        parts["word/document.xml"] = f'{HEAD}<w:document xmlns:w="{W}" xmlns:r="{OFFICE_NS}/relationships"><w:body>{"".join(self.body)}{section}</w:body></w:document>'
        styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{36 - 4 * i}"/></w:rPr></w:style>' for i in range(1, 7))
        parts["word/styles.xml"] = f'{HEAD}<w:styles xmlns:w="{W}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>{styles}</w:styles>'
        levels = lambda fmt, txt: "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{txt.format(i + 1)}"/><w:pPr><w:ind w:left="{720 * (i + 1)}" w:hanging="360"/></w:pPr></w:lvl>' for i in range(9))
        parts["word/numbering.xml"] = f'{HEAD}<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0">{levels("bullet", "•")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels("decimal", "%{}.")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
        parts["word/_rels/document.xml.rels"] = relationships(self.rels)
        parts["docProps/core.xml"] = core_properties(self.properties)
        parts["_rels/.rels"] = relationships([("rId1", "officeDocument", "word/document.xml"), ("rId2", f"{'http://schemas.openxmlformats.org/package/2006'}/relationships/metadata/core-properties", "docProps/core.xml")])
        for n, d in self.media.items():
            parts["word/" + n] = d
        return package({"[Content_Types].xml": content_types(types, {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif"}), **parts})


def _parts(data: bytes) -> dict[str, bytes]:
    pkg = Package(data)
    return {n: pkg.zip.read(n) for n in pkg.names}


def fill(data: bytes, values: dict[str, str | None]) -> bytes:
    """{{Key}} in every XML part replaced; null is empty. A placeholder that runs break up isn't found."""
    parts = _parts(data)
    for n, raw in parts.items():
        if n.endswith((".xml", ".rels")):
            s = raw.decode("utf-8")
            for k, v in values.items():
                s = s.replace("{{" + k + "}}", esc(v or ""))
            parts[n] = s.encode()
    return package(parts)


def _expand(xml: str, name: str, items: list[dict], row: str) -> str:
    """The rows between {{#name}} and {{/name}} once for each item; the markers' rows go. Without both, nothing."""
    rows = [(m.start(), m.end()) for m in re.finditer(rf"<{row}[ >].*?</{row}>", xml, re.DOTALL)]
    first = next((i for i, (a, b) in enumerate(rows) if "{{#" + name + "}}" in xml[a:b]), None)
    last = next((i for i, (a, b) in enumerate(rows) if "{{/" + name + "}}" in xml[a:b] and first is not None and i >= first), None)
    if first is None or last is None:
        return xml
    lines = [xml[a:b] for a, b in rows[first + 1 : last]]
    if first == last:
        a, b = rows[first]
        lines = [xml[a:b].replace("{{#" + name + "}}", "").replace("{{/" + name + "}}", "")]
    out = ""
    for item in items:
        for line in lines:
            for k, v in item.items():
                line = line.replace("{{" + k + "}}", esc(K.text_of(v)))
            out += line
    return xml[: rows[first][0]] + out + xml[rows[last][1] :]


def fill_table(data: bytes, name: str, items: list[dict]) -> bytes:
    parts = _parts(data)
    parts["word/document.xml"] = _expand(parts["word/document.xml"].decode("utf-8"), name, items, "w:tr").encode()
    return package(parts)


def fill_image(data: bytes, placeholder: str, image: bytes, near: int = 2000, part: str = "word/document.xml") -> bytes:
    """Replaces the picture whose reference stands closest to {{placeholder}}, at most `near` characters away."""
    parts = _parts(data)
    xml = parts[part].decode("utf-8")
    mark = "{{" + placeholder + "}}"
    at = xml.find(mark)
    found = sorted((abs(m.start() - at), m[1]) for m in re.finditer(r'r:embed="([^"]+)"', xml) if at >= 0 and abs(m.start() - at) <= near)
    if found:
        target = Package(data).relations(part)[found[0][1]]["target"]
        parts[target] = image
        parts[part] = xml.replace(mark, "").encode()
    return package(parts)


def field_value(name: str, record: dict[str, str]) -> str | None:
    """A record's value by the field's name: exactly, else in any case, else without spaces."""
    if name in record:
        return record[name]
    for norm in (str.lower, lambda s: s.lower().replace(" ", "")):
        for k, v in record.items():
            if norm(k) == norm(name):
                return v
    return None


_FIELD = re.compile(r'<w:r(?: [^>]*)?>(?:(?!</w:r>).)*?<w:fldChar[^>]*w:fldCharType="begin"[^>]*/>.*?<w:instrText[^>]*>\s*MERGEFIELD\s+(?:&quot;|")?(.*?)(?:&quot;|")?(?:\s+\\[^<]*)?\s*</w:instrText>.*?w:fldCharType="end"[^>]*/>\s*</w:r>', re.DOTALL)


def mail_merge(data: bytes, records: list[dict[str, str]]) -> bytes:
    """The template once for each record, on pages of their own; missing fields stay. No records: the template."""
    if not records:
        return data
    parts = _parts(data)
    xml = parts["word/document.xml"].decode("utf-8")
    m = re.search(r"(<w:body>)(.*?)((?:<w:sectPr(?: [^>]*)?>(?:(?!<w:sectPr).)*</w:sectPr>|<w:sectPr[^>]*/>)?)(</w:body>)", xml, re.DOTALL)
    bodies = []
    for record in records:

        def one(f: re.Match, record=record) -> str:
            v = field_value(f[1].strip(), record)
            return f[0] if v is None else Writer.run(str(v))

        bodies.append(_FIELD.sub(one, m[2]))
    page = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    parts["word/document.xml"] = (xml[: m.end(1)] + page.join(bodies) + m[3] + xml[m.start(4) :]).encode()
    parse_xml(parts["word/document.xml"])
    return package(parts)


def from_markdown(doc: dict) -> bytes:
    """A Markdown tree as a document."""
    from . import markdown as M

    w = Writer()

    def runs(nodes: list[dict], **style) -> list[dict]:
        out = []
        for n in nodes:
            kind = n["kind"]
            more = {"strong": {"bold": True}, "emphasis": {"italic": True}, "strong_emphasis": {"bold": True, "italic": True}, "strike": {"strike": True}, "link": {"underline": True, "color": "0563C1"}}.get(kind, {})
            out += runs(n["children"], **{**style, **more}) if n.get("children") else [{"text": M.plain(n), **style}]
        return [r for r in out if r["text"]]

    def block(n: dict, level: int = 0, num: int | None = None) -> None:
        kind = n["kind"]
        if kind == "heading":
            w.paragraph(runs(n["children"]), style=f"Heading{n['level']}")
        elif kind == "paragraph":
            w.paragraph(runs(n["children"]), num=(num, level) if num else None)
        elif kind in ("bullet_list", "ordered_list"):
            for item in n["children"]:
                for c in item["children"]:
                    block(c, level + (c["kind"] in ("bullet_list", "ordered_list")), 1 if kind == "bullet_list" else 2)
        elif kind == "table":
            w.table([[M.plain(c) for c in r["children"]] for r in n["children"]])
        elif kind == "rule":
            w.rule()
        elif kind in ("code_block", "html"):
            w.paragraph(n["text"])
        else:
            for c in n.get("children", ()):
                block(c, level, num)

    block(doc)
    return w.save()


