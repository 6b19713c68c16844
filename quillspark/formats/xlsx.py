"""Workbooks (xlsx): typed rows, sheet parts and a writer."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
from collections.abc import Iterator
from decimal import Decimal

from ..functions import kernels as K
from .xml import HEAD, OFFICE_NS, Package, attr, children, content_types, core_properties, esc, every, find, local, package, parse as parse_xml, qattr, read_core, relationships
from .xml import text as inner

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


class Workbook:
    def __init__(self, data: bytes):
        self.pkg = Package(data)
        self.path = next((r["target"] for r in self.pkg.relations("").values() if r["type"] == "officeDocument"), "xl/workbook.xml")
        self.root = self.pkg.xml(self.path)
        rels = self.pkg.relations(self.path)
        self.sheets: dict[str, str] = {}
        self.states: dict[str, str] = {}
        for s in every(find(self.root, "sheets"), "sheet"):
            target = rels.get(attr(s, "id") or "", {}).get("target")
            if target:
                self.sheets[s.get("name", "")] = target
                self.states[s.get("name", "")] = s.get("state", "visible")
        part = next((r["target"] for r in rels.values() if r["type"] == "sharedStrings"), "xl/sharedStrings.xml")
        # phonetic runs are not text
        self.strings = ["".join(inner(t) for t in every_text(si)) for si in children(self.pkg.xml(part), "si")]
        part = next((r["target"] for r in rels.values() if r["type"] == "styles"), "xl/styles.xml")
        self.styles = self.pkg.xml(part)
        self.codes = {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in every(find(self.styles, "numFmts"), "numFmt")}
        self.formats = [int(x.get("numFmtId", 0)) for x in children(find(self.styles, "cellXfs"), "xf")]

    def properties(self) -> dict[str, str]:
        return read_core(self.pkg)

    def sheet(self, name: str | None):
        """The sheet's tree; the first by default, an unknown name raises KeyError."""
        if name is None:
            name = next(iter(self.sheets), None)
        if name not in self.sheets:
            raise KeyError(name)
        return self.pkg.xml(self.sheets[name])

    def value(self, c):
        """A cell's value: by type, then by the number format of its style."""
        kind, style = c.get("t"), c.get("s")
        raw = None
        for e in c:
            n = local(e)
            if n == "v":
                raw = e.text or ""
                break
            if n == "is":
                raw = inner(e)
        if raw is None:
            return None
        if kind == "b":
            return raw.strip() == "1" or raw.strip().lower() == "true"
        if kind == "s":
            k = int(raw) if raw.strip().isdigit() else -1
            # a shared string stays text, whatever its style
            return self.strings[k] if 0 <= k < len(self.strings) else None
        if kind in ("str", "inlineStr", "e"):
            return raw
        if kind == "d":
            return dt.datetime.fromisoformat(raw.rstrip("Z"))
        if style is not None:
            k = int(style)
            if not 0 <= k < len(self.formats):
                return raw
            number = self.formats[k]
            return K.typed_value(raw, number, self.codes.get(number))
        return K.plain_value(raw)

    def rows(self, name: str | None = None) -> Iterator[list]:
        """Rows with values; gaps are None, rows shorter than the first are filled up, longer ones stay."""
        width = None
        for r in children(find(self.sheet(name), "sheetData"), "row"):
            out: list = []
            for c in children(r, "c"):
                at = K.column_index(c.get("r", "")) if c.get("r") else len(out)
                out += [None] * (at - len(out))
                out[at:] = [self.value(c)]
            if width is None:
                width = len(out)
            yield out + [None] * (width - len(out))

    def cells(self, name: str | None = None) -> Iterator[dict]:
        """Every cell with its place, value, style index and formula; shared formulas are moved to the cell."""
        shared: dict[str, tuple[str, int, int]] = {}
        row = -1
        for r in children(find(self.sheet(name), "sheetData"), "row"):
            row = int(r.get("r", row + 2)) - 1
            column = -1
            for c in children(r, "c"):
                column = K.column_index(c.get("r", "")) if c.get("r") else column + 1
                f, formula = find(c, "f"), None
                if f is not None:
                    formula = inner(f) or None
                    if f.get("t") == "shared" and f.get("si"):
                        if formula:
                            shared[f.get("si")] = (formula, row, column)
                        elif f.get("si") in shared:
                            base, r0, c0 = shared[f.get("si")]
                            formula = K.shift_formula(base, row - r0, column - c0)
                yield {"row": row, "col": column, "value": self.value(c), "style": int(c.get("s", 0)), "formula": formula}

    def _related(self, name: str, kind: str) -> list[str]:
        return [r["target"] for r in self.pkg.relations(self.sheets[name]).values() if r["type"] == kind]

    def merges(self, name: str) -> list[tuple[int, int, int, int]]:
        found = (K.range_ref(m.get("ref", "")) for m in every(find(self.sheet(name), "mergeCells"), "mergeCell"))
        return [m for m in found if m]

    def hyperlinks(self, name: str) -> dict[str, str]:
        rels = self.pkg.relations(self.sheets[name])
        out = {}
        for h in every(find(self.sheet(name), "hyperlinks"), "hyperlink"):
            target = rels.get(attr(h, "id") or "", {}).get("target")
            if target or h.get("location"):
                out[h.get("ref", "")] = target or "#" + h.get("location", "")
        return out

    def widths(self, name: str) -> dict[int, float]:
        return {k - 1: float(c.get("width", 0)) for c in every(find(self.sheet(name), "cols"), "col") for k in range(int(c.get("min", 1)), min(int(c.get("max", 1)), 16384) + 1) if c.get("width")}

    def heights(self, name: str) -> dict[int, float]:
        return {int(r.get("r", 1)) - 1: float(r.get("ht")) for r in children(find(self.sheet(name), "sheetData"), "row") if r.get("ht")}

    def outlines(self, name: str) -> dict[str, dict[int, int]]:
        cols = {k - 1: int(c.get("outlineLevel")) for c in every(find(self.sheet(name), "cols"), "col") if c.get("outlineLevel") for k in range(int(c.get("min", 1)), min(int(c.get("max", 1)), 16384) + 1)}
        rows = {int(r.get("r", 1)) - 1: int(r.get("outlineLevel")) for r in children(find(self.sheet(name), "sheetData"), "row") if r.get("outlineLevel")}
        return {"columns": cols, "rows": rows}

    def freeze(self, name: str) -> tuple[int, int] | None:
        for p in every(find(self.sheet(name), "sheetViews"), "pane"):
            if p.get("state") == "frozen":
                return int(float(p.get("ySplit", 0))), int(float(p.get("xSplit", 0)))
        return None

    def auto_filter(self, name: str) -> str | None:
        f = find(self.sheet(name), "autoFilter")
        return f.get("ref") if f is not None else None

    def tab_color(self, name: str) -> str | None:
        c = find(self.sheet(name), "sheetPr", "tabColor")
        return K.rgb(c.get("rgb")) if c is not None else None

    def protection(self, name: str | None = None) -> dict | None:
        e = find(self.root, "workbookProtection") if name is None else find(self.sheet(name), "sheetProtection")
        return dict(e.attrib) if e is not None else None

    def calculation(self) -> dict | None:
        e = find(self.root, "calcPr")
        return dict(e.attrib) if e is not None else None

    def page_setup(self, name: str) -> dict:
        root, out = self.sheet(name), {}
        for part in ("pageSetup", "pageMargins", "printOptions"):
            e = find(root, part)
            out |= {k.rpartition("}")[2]: v for k, v in e.attrib.items()} if e is not None else {}
        hf = find(root, "headerFooter")
        return out | {local(e): inner(e) for e in (hf if hf is not None else ())}

    def names(self) -> dict[str, str]:
        return {n.get("name", ""): inner(n) for n in every(find(self.root, "definedNames"), "definedName") if not n.get("name", "").startswith("_xlnm.")}

    def range_values(self, ref: str) -> list[list]:
        """Values of a range such as Sheet!$A$1:$B$2, or of a defined name (in any case)."""
        ref = {k.lower(): v for k, v in self.names().items()}.get(ref.lower(), ref)
        sheet, _, area = ref.rpartition("!")
        area = area.replace("$", "")
        r1, c1, r2, c2 = K.range_ref(area) or K.cell_ref(area) * 2
        found = {(c["row"], c["col"]): c["value"] for c in self.cells(sheet.strip("'").replace("''", "'") or None) if r1 <= c["row"] <= r2 and c1 <= c["col"] <= c2}
        return [[found.get((r, c)) for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)]

    def comments(self, name: str) -> list[dict]:
        out = []
        for part in self._related(name, "comments"):
            root = self.pkg.xml(part)
            authors = [inner(a) for a in every(find(root, "authors"), "author")]
            for c in every(find(root, "commentList"), "comment"):
                k = int(c.get("authorId", 0))
                out.append({"ref": c.get("ref"), "author": authors[k] if k < len(authors) else None, "text": "".join(inner(t) for t in every(find(c, "text"), "t"))})
        return out

    def validations(self, name: str) -> list[dict]:
        out = []
        for v in every(find(self.sheet(name), "dataValidations"), "dataValidation"):
            one, two = find(v, "formula1"), find(v, "formula2")
            first = inner(one) if one is not None else None
            items = first.strip('"').split(",") if v.get("type") == "list" and first and first.startswith('"') else None
            out.append({"ref": v.get("sqref"), "type": v.get("type"), "operator": v.get("operator", "between"), "formula1": first, "formula2": inner(two) if two is not None else None, "items": items, "prompt": v.get("prompt"), "error": v.get("error")})
        return out

    def conditional_formats(self, name: str) -> list[dict]:
        out = []
        for block in children(self.sheet(name), "conditionalFormatting"):
            for r in children(block, "cfRule"):
                stops = [(e.get("type"), e.get("val")) for e in every(r, "cfvo")]
                colors = [K.rgb(e.get("rgb")) for e in every(r, "color")]
                out.append({"ref": block.get("sqref"), "type": r.get("type"), "operator": r.get("operator"), "formulas": [inner(f) for f in children(r, "formula")], "stops": stops, "colors": colors, "priority": int(r.get("priority", 0))})
        return out

    def tables(self, name: str) -> list[dict]:
        out = []
        for part in self._related(name, "table"):
            t = self.pkg.xml(part)
            if t is not None:
                style = find(t, "tableStyleInfo")
                out.append({"name": t.get("displayName") or t.get("name"), "ref": t.get("ref"), "columns": [c.get("name") for c in every(t, "tableColumn")], "style": style.get("name") if style is not None else None})
        return out

    def _drawings(self, name: str) -> Iterator[tuple[str, object]]:
        for part in self._related(name, "drawing"):
            root = self.pkg.xml(part)
            if root is not None:
                yield part, root

    def images(self, name: str) -> list[dict]:
        out = []
        for part, root in self._drawings(name):
            rels = self.pkg.relations(part)
            for anchor in root:
                at = find(anchor, "from")
                for b in every(anchor, "blip"):
                    target = rels.get(attr(b, "embed") or "", {}).get("target")
                    if target and target in self.pkg:
                        out.append({"row": int(inner(find(at, "row")) or 0), "col": int(inner(find(at, "col")) or 0), "name": target, "data": self.pkg.read(target)})
        return out

    def charts(self, name: str) -> list[dict]:
        out = []
        for part, _ in self._drawings(name):
            for r in self.pkg.relations(part).values():
                if r["type"] == "chart" and (root := self.pkg.xml(r["target"])) is not None:
                    out.append(chart(root))
        return out

    def sparklines(self, name: str) -> list[dict]:
        return [{"type": g.get("type", "line"), "items": [{"formula": inner(find(s, "f")), "ref": inner(find(s, "sqref"))} for s in every(g, "sparkline")]} for g in every(self.sheet(name), "sparklineGroup")]

    def cell_style(self, index: int) -> dict:
        """A style index resolved to number format, font, fill, border and alignment."""
        xfs = children(find(self.styles, "cellXfs"), "xf")
        if not 0 <= index < len(xfs):
            return {}
        x = xfs[index]
        pick = lambda part, item, key: (lambda xs, k: xs[k] if 0 <= k < len(xs) else None)(children(find(self.styles, part), item), int(x.get(key, 0)))
        font, fill, border, align = pick("fonts", "font", "fontId"), pick("fills", "fill", "fillId"), pick("borders", "border", "borderId"), find(x, "alignment")
        val = lambda e, n, k="val": (lambda c: c.get(k) if c is not None else None)(find(e, n))
        number = int(x.get("numFmtId", 0))
        fg = find(fill, "patternFill", "fgColor")
        return {
            "number_format": self.codes.get(number), "number_format_id": number, "font_name": val(font, "name"), "font_size": float(val(font, "sz") or 0) or None, "bold": find(font, "b") is not None,
            "italic": find(font, "i") is not None, "underline": find(font, "u") is not None, "font_color": K.rgb(val(font, "color", "rgb")), "fill": K.rgb(fg.get("rgb")) if fg is not None else None,
            "border": {local(e): e.get("style") for e in (border if border is not None else ()) if e.get("style")}, "horizontal": align.get("horizontal") if align is not None else None, "vertical": align.get("vertical") if align is not None else None, "wrap": align is not None and align.get("wrapText") == "1",
        }

    def pivots(self, name: str) -> list[dict]:
        """Declared pivot tables: source, fields by axis, data fields, and each cached field's items."""
        out = []
        for part in self._related(name, "pivotTable"):
            t = self.pkg.xml(part)
            cache = next((r["target"] for r in self.pkg.relations(part).values() if r["type"] == "pivotCacheDefinition"), None)
            c = self.pkg.xml(cache) if cache else None
            source = every(c, "worksheetSource")
            fields = [f.get("name") for f in every(c, "cacheField")]
            axis = lambda tag, item, key, t=t, fields=fields: [fields[int(e.get(key))] for e in every(find(t, tag), item) if int(e.get(key, -1)) >= 0]
            data = [{"field": fields[int(d.get("fld"))], "function": d.get("subtotal", "sum"), "caption": d.get("name")} for d in every(t, "dataField")]
            items = {f.get("name"): [s.get("v") for s in every(f, "s")] for f in every(c, "cacheField")}
            out.append({"source": f"{source[0].get('sheet')}!{source[0].get('ref')}" if source else None, "rows": axis("rowFields", "field", "x"), "columns": axis("colFields", "field", "x"), "filters": axis("pageFields", "pageField", "fld"), "data": data, "items": items})
        return out

    def other_parts(self) -> list[str]:
        """Parts of the package that this model doesn't read."""
        known = re.compile(r"(\[content_types\]\.xml|.*\.rels|docprops/.*|xl/(workbook|styles|sharedstrings)\.xml|xl/(worksheets|comments|tables|drawings|charts|media|pivotCache|pivotTables)/?.*)$", re.IGNORECASE)
        return [n for n in self.pkg.names if not known.match(n)]


def every_text(si) -> list:
    """Text elements of a string item outside phonetic runs."""
    out = [t for t in si if local(t) == "t"]
    for r in children(si, "r"):
        out += children(r, "t")
    return out


def chart(root) -> dict:
    """A chart's kind, categories and series from its caches."""
    plot = find(root, "chart", "plotArea")
    kind = next((local(e) for e in (plot if plot is not None else ()) if local(e).endswith("Chart")), None)
    cache = lambda e: [inner(find(p, "v")) for p in every(e, "pt")]
    series, categories = [], []
    for s in every(plot, "ser"):
        categories = categories or cache(find(s, "cat")) or cache(find(s, "xVal"))
        values = find(s, "val") if find(s, "val") is not None else find(s, "yVal")
        series.append({"name": "".join(cache(find(s, "tx"))), "values": [float(v) if v else None for v in cache(values)]})
    return {"chart_type": kind.removesuffix("Chart") if kind else None, "categories": categories, "series": series}


def sheets(data: bytes) -> list[tuple[str, list[list]]]:
    w = Workbook(data)
    return [(n, list(w.rows(n))) for n in w.sheets]


def text(data: bytes) -> str | None:
    return K.csv_text(sheets(data))


def markdown(data: bytes) -> str | None:
    return K.md_text(sheets(data))


# Number formats that the writer uses, by the kind of value.
_STYLES = {"general": (0, None), "date": (14, None), "datetime": (164, "yyyy-mm-dd hh:mm:ss"), "time": (46, None), "percent": (10, None), "text": (49, None), "integer": (1, None), "decimal": (2, None)}
_INDEX = {k: i for i, k in enumerate(_STYLES)}


class Formula:
    """A formula's text with the value it had."""

    def __init__(self, formula: str, cached=None):
        self.formula, self.cached = formula.removeprefix("="), cached


class Writer:
    """Collects sheets and emits the package. Sheets are made on demand."""

    def __init__(self):
        self.data: dict[str, list[str]] = {}
        self.meta: dict[str, dict] = {}
        self.strings: dict[str, int] = {}
        self.defined: dict[str, str] = {}
        self.properties: dict[str, str] = {}
        self.custom: list[dict] = []
        self.hidden: set[str] = set()
        self.workbook_password: str | None = None
        self.pivots: list[dict] = []
        self.calculation: dict[str, str] = {}

    def pivot(self, sheet: str, source: str, header: list[str], rows: list[list], row_fields: list[str], data_fields: list[tuple[str, str]], column_fields: list[str] = (), filter_fields: list[str] = (), anchor: str = "A3") -> None:
        """A pivot table of a source sheet's rows; the reader of the workbook computes it when it is opened. Field
        names match in any case; data fields are (field, Sum, Count, Average, Max or Min)."""
        at = {h.lower(): i for i, h in enumerate(header)}
        index = lambda names: [at[n.lower()] for n in names]
        self._sheet(sheet)
        self.pivots.append({"sheet": sheet, "source": source, "header": header, "rows": rows, "row": index(row_fields), "column": index(column_fields), "page": index(filter_fields), "data": [(at[f.lower()], fn) for f, fn in data_fields], "anchor": anchor})

    def _pivot_parts(self, parts: dict, types: dict) -> None:
        base = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        for n, p in enumerate(self.pivots, 1):
            used = {*p["row"], *p["column"], *p["page"]}
            # distinct values other than null, as text in binary order; long lists are left to the reader
            items = {i: sorted({K.text_of(r[i]) for r in p["rows"] if i < len(r) and r[i] is not None}) for i in range(len(p["header"]))}
            fields = "".join(f"<cacheField name={qattr(h)}>" + (f'<sharedItems count="{len(items[i])}">' + "".join(f"<s v={qattr(v)}/>" for v in items[i]) + "</sharedItems>" if i in used and len(items[i]) <= 1000 else "<sharedItems/>") + "</cacheField>" for i, h in enumerate(p["header"]))
            end = f"{K.column_name(len(p['header']) - 1)}{len(p['rows']) + 1}"
            parts[f"xl/pivotCache/pivotCacheDefinition{n}.xml"] = f'{HEAD}<pivotCacheDefinition xmlns="{MAIN}" refreshOnLoad="1" saveData="0"><cacheSource type="worksheet"><worksheetSource ref="A1:{end}" sheet={qattr(p["source"])}/></cacheSource><cacheFields count="{len(p["header"])}">{fields}</cacheFields></pivotCacheDefinition>'
            types[f"xl/pivotCache/pivotCacheDefinition{n}.xml"] = base + "pivotCacheDefinition+xml"
            axis = {**{i: "axisRow" for i in p["row"]}, **{i: "axisCol" for i in p["column"]}, **{i: "axisPage" for i in p["page"]}}
            body = ""
            for i in range(len(p["header"])):
                own = f' axis="{axis[i]}"' if i in axis else ""
                data = ' dataField="1"' if any(i == d for d, _ in p["data"]) else ""
                listed = f'<items count="{len(items[i]) + 1}">' + "".join(f'<item x="{k}"/>' for k in range(len(items[i]))) + '<item t="default"/></items>' if i in axis and len(items[i]) <= 1000 else ""
                body += f'<pivotField{own}{data} showAll="0">{listed}</pivotField>'
            group = lambda tag, item, xs: f'<{tag} count="{len(xs)}">' + "".join(item(x) for x in xs) + f"</{tag}>" if xs else ""
            functions = {"Sum": "sum", "Count": "count", "Average": "average", "Max": "max", "Min": "min"}
            row, col = K.cell_ref(p["anchor"])
            ref = f"{p['anchor']}:{K.column_name(col + max(1, len(p['data'])))}{row + 3}"
            parts[f"xl/pivotTables/pivotTable{n}.xml"] = (
                f'{HEAD}<pivotTableDefinition xmlns="{MAIN}" name="PivotTable{n}" cacheId="{n}" dataCaption="Values" rowGrandTotals="1" colGrandTotals="1"><location ref="{ref}" firstHeaderRow="1" firstDataRow="2" firstDataCol="1"/>'
                f'<pivotFields count="{len(p["header"])}">{body}</pivotFields>{group("rowFields", lambda i: f"<field x=\"{i}\"/>", p["row"])}{group("colFields", lambda i: f"<field x=\"{i}\"/>", p["column"])}{group("pageFields", lambda i: f"<pageField fld=\"{i}\" hier=\"-1\"/>", p["page"])}'
                + group("dataFields", lambda d: f'<dataField name={qattr(f"{d[1]} of {p["header"][d[0]]}")} fld="{d[0]}" subtotal="{functions[d[1]]}"/>', p["data"]) + "</pivotTableDefinition>"
            )
            types[f"xl/pivotTables/pivotTable{n}.xml"] = base + "pivotTable+xml"
            parts[f"xl/pivotTables/_rels/pivotTable{n}.xml.rels"] = relationships([("rId1", "pivotCacheDefinition", f"../pivotCache/pivotCacheDefinition{n}.xml")])

    def _sheet(self, name: str | None) -> list[str]:
        name = name or next(iter(self.data), "Sheet1")
        self.meta.setdefault(name, {})
        return self.data.setdefault(name, [])

    def style(self, **options) -> int:
        """A cell style: number_format, bold, italic, underline, size, color, fill, border, horizontal, vertical, wrap. border: a
        line for all four sides, or lines by side."""
        self.custom.append(options)
        return len(_STYLES) + len(self.custom) - 1

    def cell(self, ref: str, value, style: int | None = None, exact: bool = False) -> str:
        """A cell's markup. exact: a text stays text and a number a number, whatever they look like."""
        own = lambda kind: f' s="{_INDEX[kind] if style is None else style}"'
        given = f' s="{style}"' if style is not None else ""
        if isinstance(value, Formula):
            cached = "" if value.cached is None else f"<v>{esc(K.text_of(value.cached))}</v>"
            kind = ' t="str"' if isinstance(value.cached, str) else ""
            return f'<c r="{ref}"{given}{kind}><f>{esc(value.formula)}</f>{cached}</c>'
        if isinstance(value, bool):
            return f'<c r="{ref}"{given} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, dt.datetime):
            if value.tzinfo:
                value = value.astimezone(dt.UTC).replace(tzinfo=None)
            if value < K.EPOCH:
                value = ""
            else:
                return f'<c r="{ref}"{own("datetime")}><v>{K.date_to_serial(value)!r}</v></c>'
        if isinstance(value, dt.date):
            return self.cell(ref, "", style) if value < K.EPOCH.date() else f'<c r="{ref}"{own("date")}><v>{(value - K.EPOCH.date()).days + 2}</v></c>'
        if isinstance(value, dt.timedelta):
            return f'<c r="{ref}"{own("time")}><v>{value.total_seconds() / 86400!r}</v></c>'
        if not exact and isinstance(value, str) and (p := K.percent(value)) is not None:
            return f'<c r="{ref}"{own("percent")}><v>{p!r}</v></c>'
        if isinstance(value, int | float | Decimal):
            if isinstance(value, float) and not (value == value and abs(value) != float("inf")) or not exact and K.written_as_text(value):
                value = K.text_of(value)
            else:
                return f'<c r="{ref}"{given}><v>{K.text_of(value)}</v></c>'
        value = str(value)
        k = self.strings.setdefault(value, len(self.strings))
        return f'<c r="{ref}"{f" s=\"{_INDEX["text"]}\"" if style is None and K.plain_value(value) != value else given} t="s"><v>{k}</v></c>'

    def row(self, values: list, sheet: str | None = None, styles: list[int | None] | None = None) -> None:
        rows = self._sheet(sheet)
        n = len(rows) + 1
        cells = "".join(self.cell(f"{K.column_name(i)}{n}", v, styles[i] if styles else None) for i, v in enumerate(values) if v is not None)
        rows.append(cells)

    def rows(self, rows, sheet: str | None = None) -> None:
        self._sheet(sheet)
        for r in rows:
            self.row(list(r), sheet)

    def formula(self, formula: str, cached=None, sheet: str | None = None) -> None:
        self.row([Formula(formula, cached)], sheet)

    def put(self, key: str, value, sheet: str | None = None) -> None:
        """Layout and attached objects: widths, heights, merges, freeze, filter, links, comments, validations,
        formats, tables, images, setup, tab, password, lock (attributes of a protection), outlines, sparklines, charts."""
        name = sheet or next(iter(self.data), "Sheet1")
        self._sheet(name)
        meta = self.meta[name]
        if key in ("freeze", "filter", "tab", "password", "lock", "setup", "print_area", "print_titles"):
            meta[key] = value
        elif isinstance(value, dict) and key in ("widths", "heights", "links", "column_outlines", "row_outlines"):
            meta.setdefault(key, {}).update(value)
        else:
            meta.setdefault(key, []).append(value)

    def _styles(self) -> str:
        codes = {n: c for n, c in _STYLES.values() if c}
        fonts, fills, borders, xfs = ["<font><sz val=\"11\"/><name val=\"Calibri\"/></font>"], ['<fill><patternFill patternType="none"/></fill>', '<fill><patternFill patternType="gray125"/></fill>'], ["<border><left/><right/><top/><bottom/><diagonal/></border>"], []
        for n, _ in _STYLES.values():
            xfs.append(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>')
        at = lambda xs, x: xs.index(x) if x in xs else (xs.append(x), len(xs) - 1)[1]
        for o in self.custom:
            number = o.get("number_format_id") or 0
            if o.get("number_format"):
                number = next((k for k, c in codes.items() if c == o["number_format"]), None) or max([165, *codes]) + 1
                codes[number] = o["number_format"]
            font = "<font>" + "".join(f"<{t}/>" for k, t in (("bold", "b"), ("italic", "i"), ("underline", "u")) if o.get(k)) + f'<sz val="{o.get("size", 11):g}"/>' + (f'<color rgb="FF{o["color"]}"/>' if o.get("color") else "") + f"<name val={qattr(o.get('font', 'Calibri'))}/></font>"
            fill = f'<fill><patternFill patternType="solid"><fgColor rgb="FF{o["fill"]}"/></patternFill></fill>' if o.get("fill") else fills[0]
            lines = o.get("border") or {}
            lines = lines if isinstance(lines, dict) else dict.fromkeys(("left", "right", "top", "bottom"), lines)
            side = lambda s, b=lines: f'<{s} style="{b[s]}"><color auto="1"/></{s}>' if b.get(s) else f"<{s}/>"
            border = "<border>" + "".join(map(side, ("left", "right", "top", "bottom"))) + "<diagonal/></border>"
            align = "".join(f" {k}={qattr(o[k])}" for k in ("horizontal", "vertical") if o.get(k)) + (' wrapText="1"' if o.get("wrap") else "")
            align = f"<alignment{align}/>" if align else ""
            xfs.append(f'<xf numFmtId="{number}" fontId="{at(fonts, font)}" fillId="{at(fills, fill)}" borderId="{at(borders, border)}" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyBorder="1">{align}</xf>')
        group = lambda tag, xs: f'<{tag} count="{len(xs)}">{"".join(xs)}</{tag}>'
        numbers = group("numFmts", [f'<numFmt numFmtId="{n}" formatCode={qattr(c)}/>' for n, c in codes.items()])
        return f'{HEAD}<styleSheet xmlns="{MAIN}">{numbers}{group("fonts", fonts)}{group("fills", fills)}{group("borders", borders)}<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>{group("cellXfs", xfs)}<dxfs count="1"><dxf><fill><patternFill><bgColor rgb="FFFFC7CE"/></patternFill></fill></dxf></dxfs></styleSheet>'

    def _sheet_xml(self, name: str, k: int, parts: dict, types: dict) -> str:
        m = self.meta.get(name, {})
        rels: list[tuple] = []
        tab = f'<sheetPr><tabColor rgb="FF{m["tab"]}"/></sheetPr>' if m.get("tab") else ""
        view = ""
        if m.get("freeze"):
            r, c = m["freeze"]
            view = f'<sheetViews><sheetView workbookViewId="0"><pane{f" xSplit=\"{c}\"" if c else ""}{f" ySplit=\"{r}\"" if r else ""} topLeftCell="{K.column_name(c)}{r + 1}" activePane="bottomRight" state="frozen"/></sheetView></sheetViews>'
        levels = m.get("column_outlines", {})
        cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{m.get("widths", {}).get(c, 9.14):g}" customWidth="1"{f" outlineLevel=\"{levels[c]}\"" if c in levels else ""}/>' for c in sorted({*m.get("widths", {}), *levels}))
        heights, outlines = m.get("heights", {}), m.get("row_outlines", {})
        rows = "".join(
            f'<row r="{i + 1}"{f" ht=\"{heights[i]:g}\" customHeight=\"1\"" if i in heights else ""}{f" outlineLevel=\"{outlines[i]}\"" if i in outlines else ""}>{cells}</row>' for i, cells in enumerate(self.data[name]) if cells or i in heights or i in outlines
        )
        lock = f'<sheetProtection sheet="1" objects="1" scenarios="1"{f" password=\"{password_hash(m["password"]):04X}\"" if m["password"] else ""}/>' if "password" in m else ""
        if m.get("lock"):
            lock = "<sheetProtection" + "".join(f" {a}={qattr(v)}" for a, v in m["lock"].items()) + "/>"
        auto = f"<autoFilter ref={qattr(m['filter'])}/>" if m.get("filter") else ""
        merged = f'<mergeCells count="{len(m["merges"])}">' + "".join(f"<mergeCell ref={qattr(r)}/>" for r in m["merges"]) + "</mergeCells>" if m.get("merges") else ""
        formats = "".join(conditional(f, i + 1) for i, f in enumerate(m.get("formats", ())))
        checks = f'<dataValidations count="{len(m["validations"])}">' + "".join(map(validation, m["validations"])) + "</dataValidations>" if m.get("validations") else ""
        links = ""
        for ref, url in m.get("links", {}).items():
            if url.startswith("#"):
                links += f"<hyperlink ref={qattr(ref)} location={qattr(url[1:])}/>"
            else:
                rels.append((f"rId{len(rels) + 1}", "hyperlink", url, True))
                links += f'<hyperlink ref={qattr(ref)} r:id="rId{len(rels)}"/>'
        links = f"<hyperlinks>{links}</hyperlinks>" if links else ""
        setup = m.get("setup") or {}
        margins = {s: setup[s] for s in ("left", "right", "top", "bottom", "header", "footer") if s in setup}
        page = ("<pageMargins" + "".join(f' {s}="{margins.get(s, 0.5)}"' for s in ("left", "right", "top", "bottom", "header", "footer")) + "/>") if margins else ""
        page += f"<pageSetup orientation={qattr(setup['orientation'])}{f' paperSize=\"{setup["paper"]}\"' if 'paper' in setup else ''}/>" if setup.get("orientation") else ""
        page += f"<headerFooter>{f'<oddHeader>{esc(setup["head"])}</oddHeader>' if setup.get('head') else ''}{f'<oddFooter>{esc(setup["foot"])}</oddFooter>' if setup.get('foot') else ''}</headerFooter>" if setup.get("head") or setup.get("foot") else ""
        for tag, key, limit in (("rowBreaks", "row_breaks", 16383), ("colBreaks", "column_breaks", 1048575)):
            if m.get(key):
                page += f'<{tag} count="{len(m[key])}" manualBreakCount="{len(m[key])}">' + "".join(f'<brk id="{b}" max="{limit}" man="1"/>' for b in m[key]) + f"</{tag}>"
        drawing = ""
        if m.get("images") or m.get("charts"):
            rels.append((f"rId{len(rels) + 1}", "drawing", f"../drawings/drawing{k}.xml"))
            drawing = f'<drawing r:id="rId{len(rels)}"/>'
            self._drawing(m, k, parts, types)
        comments = ""
        if m.get("comments"):
            rels.append((f"rId{len(rels) + 1}", "comments", f"../comments{k}.xml"))
            authors = list(dict.fromkeys(c.get("author") or "" for c in m["comments"]))
            body = "".join(f'<comment ref={qattr(c["ref"])} authorId="{authors.index(c.get("author") or "")}"><text><r><t xml:space="preserve">{esc(c["text"])}</t></r></text></comment>' for c in m["comments"])
            parts[f"xl/comments{k}.xml"] = f'{HEAD}<comments xmlns="{MAIN}"><authors>{"".join(f"<author>{esc(a)}</author>" for a in authors)}</authors><commentList>{body}</commentList></comments>'
            types[f"xl/comments{k}.xml"] = "application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml"
        table_parts = ""
        for t in m.get("tables", ()):
            n = sum(p.startswith("xl/tables/") for p in parts) + 1
            rels.append((f"rId{len(rels) + 1}", "table", f"../tables/table{n}.xml"))
            table_parts += f'<tablePart r:id="rId{len(rels)}"/>'
            columns = "".join(f'<tableColumn id="{i + 1}" name={qattr(c)}/>' for i, c in enumerate(t["columns"]))
            parts[f"xl/tables/table{n}.xml"] = (
                f'{HEAD}<table xmlns="{MAIN}" id="{n}" name={qattr(t["name"])} displayName={qattr(t["name"])} ref={qattr(t["ref"])} totalsRowShown="0"><autoFilter ref={qattr(t["ref"])}/><tableColumns count="{len(t["columns"])}">{columns}</tableColumns><tableStyleInfo name={qattr(t.get("style") or "TableStyleMedium2")} showRowStripes="1"/></table>'
            )
            types[f"xl/tables/table{n}.xml"] = "application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml"
        table_parts = f'<tableParts count="{len(m["tables"])}">{table_parts}</tableParts>' if table_parts else ""
        sparks = ""
        if m.get("sparklines"):
            x14 = "http://schemas.microsoft.com/office/spreadsheetml/2009/9/main"
            groups = "".join(
                f'<x14:sparklineGroup type="{g.get("type", "line")}"><x14:sparklines>' + "".join(f"<x14:sparkline><xm:f>{esc(s['formula'])}</xm:f><xm:sqref>{esc(s['ref'])}</xm:sqref></x14:sparkline>" for s in g["items"]) + "</x14:sparklines></x14:sparklineGroup>" for g in m["sparklines"]
            )
            sparks = f'<extLst><ext xmlns:x14="{x14}" uri="{{05C60535-1F16-4fd2-B633-F4F36F0B64E0}}"><x14:sparklineGroups xmlns:xm="http://schemas.microsoft.com/office/excel/2006/main">{groups}</x14:sparklineGroups></ext></extLst>'
        rels += [(f"rIdP{n}", "pivotTable", f"../pivotTables/pivotTable{n}.xml") for n, p in enumerate(self.pivots, 1) if p["sheet"] == name]
        if rels:
            parts[f"xl/worksheets/_rels/sheet{k}.xml.rels"] = relationships(rels)
        return f'{HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{OFFICE_NS}/relationships">{tab}{view}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{rows}</sheetData>{lock}{auto}{merged}{formats}{checks}{links}{page}{drawing}{comments}{table_parts}{sparks}</worksheet>'

    def _drawing(self, m: dict, k: int, parts: dict, types: dict) -> None:
        rels, body = [], ""
        ns = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
        corner = lambda tag, r, c: f"<xdr:{tag}><xdr:col>{c}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{r}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:{tag}>"
        for kind in ("images", "charts"):
            for i, x in enumerate(m.get(kind, ())):
                rid = f"rId{len(rels) + 1}"
                r, c = x.get("row", 0), x.get("col", 0)
                frame = corner("from", r, c) + corner("to", r + x.get("rows", 10), c + x.get("cols", 5))
                if kind == "images":
                    name = f"xl/media/image{k}_{i + 1}.{x.get('ext', 'png')}"
                    parts[name] = x["data"]
                    rels.append((rid, "image", "/" + name))
                    obj = f'<xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{len(rels) + 1}" name="Picture {i + 1}"/><xdr:cNvPicPr/></xdr:nvPicPr><xdr:blipFill><a:blip xmlns:r="{OFFICE_NS}/relationships" r:embed="{rid}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill><xdr:spPr><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr></xdr:pic>'
                else:
                    name = f"xl/charts/chart{k}_{i + 1}.xml"
                    parts[name] = chart_xml(x)
                    types[name] = "application/vnd.openxmlformats-officedocument.drawingml.chart+xml"
                    rels.append((rid, "chart", "/" + name))
                    obj = f'<xdr:graphicFrame macro=""><xdr:nvGraphicFramePr><xdr:cNvPr id="{len(rels) + 1}" name="Chart {i + 1}"/><xdr:cNvGraphicFramePr/></xdr:nvGraphicFramePr><xdr:xfrm><a:off x="0" y="0"/><a:ext cx="0" cy="0"/></xdr:xfrm><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:r="{OFFICE_NS}/relationships" r:id="{rid}"/></a:graphicData></a:graphic></xdr:graphicFrame>'
                body += f"<xdr:twoCellAnchor>{frame}{obj}<xdr:clientData/></xdr:twoCellAnchor>"
        parts[f"xl/drawings/drawing{k}.xml"] = f"{HEAD}<xdr:wsDr {ns}>{body}</xdr:wsDr>"
        parts[f"xl/drawings/_rels/drawing{k}.xml.rels"] = relationships(rels)
        types[f"xl/drawings/drawing{k}.xml"] = "application/vnd.openxmlformats-officedocument.drawing+xml"

    def save(self) -> bytes:
        self._sheet(None)
        parts: dict[str, str | bytes] = {}
        types = {"xl/workbook.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml", "xl/styles.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml", "xl/sharedStrings.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"}
        types["docProps/core.xml"] = "application/vnd.openxmlformats-package.core-properties+xml"
        for k, name in enumerate(self.data, 1):
            parts[f"xl/worksheets/sheet{k}.xml"] = self._sheet_xml(name, k, parts, types)
            types[f"xl/worksheets/sheet{k}.xml"] = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
        listed = "".join(f'<sheet name={qattr(n)} sheetId="{k}"{" state=\"hidden\"" if n in self.hidden else ""} r:id="rId{k}"/>' for k, n in enumerate(self.data, 1))
        names = "".join(f"<definedName name={qattr(k)}>{esc(v)}</definedName>" for k, v in self.defined.items())
        for k, n in enumerate(self.data):
            quoted = "'" + n.replace("'", "''") + "'!"
            for key, name in (("print_area", "_xlnm.Print_Area"), ("print_titles", "_xlnm.Print_Titles")):
                if self.meta[n].get(key):
                    names += f'<definedName name="{name}" localSheetId="{k}">{esc(quoted + self.meta[n][key])}</definedName>'
        self._pivot_parts(parts, types)
        caches = "".join(f'<pivotCache cacheId="{k}" r:id="rIdC{k}"/>' for k in range(1, len(self.pivots) + 1))
        caches = f"<pivotCaches>{caches}</pivotCaches>" if caches else ""
        lock = f'<workbookProtection lockStructure="1"{f" workbookPassword=\"{password_hash(self.workbook_password):04X}\"" if self.workbook_password else ""}/>' if self.workbook_password is not None else ""
        calc = "<calcPr" + "".join(f" {a}={qattr(v)}" for a, v in self.calculation.items()) + "/>" if self.calculation else ""
        parts["xl/workbook.xml"] = f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE_NS}/relationships">{lock}<sheets>{listed}</sheets>{f"<definedNames>{names}</definedNames>" if names else ""}{calc}{caches}</workbook>'
        n = len(self.data)
        rels = [(f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, n + 1)] + [(f"rId{n + 1}", "styles", "styles.xml"), (f"rId{n + 2}", "sharedStrings", "sharedStrings.xml")]
        rels += [(f"rIdC{k}", "pivotCacheDefinition", f"pivotCache/pivotCacheDefinition{k}.xml") for k in range(1, len(self.pivots) + 1)]
        parts["xl/_rels/workbook.xml.rels"] = relationships(rels)
        parts["xl/styles.xml"] = self._styles()
        parts["xl/sharedStrings.xml"] = f'{HEAD}<sst xmlns="{MAIN}" uniqueCount="{len(self.strings)}">' + "".join(f'<si><t xml:space="preserve">{esc(s)}</t></si>' for s in self.strings) + "</sst>"
        parts["docProps/core.xml"] = core_properties(self.properties)
        parts["_rels/.rels"] = relationships([("rId1", "officeDocument", "xl/workbook.xml"), ("rId2", "http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties", "docProps/core.xml")])
        return package({"[Content_Types].xml": content_types(types, {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif"}), **parts})


def password_hash(password: str) -> int:
    """The 16-bit verifier that sheets keep of a password."""
    h = 0
    for c in reversed(password[:15]):
        h = ((h >> 14) & 1) | ((h << 1) & 0x7FFF)
        h ^= ord(c) & 0xFF
    h = ((h >> 14) & 1) | ((h << 1) & 0x7FFF)
    return h ^ len(password) ^ 0xCE4B


def lock_attributes(password: str, salt: bytes, spins: int = 100_000) -> dict[str, str]:
    """A protection's attributes with the iterated SHA-512 verifier of a password."""
    h = hashlib.sha512(salt + password.encode("utf-16-le")).digest()
    for i in range(spins):
        h = hashlib.sha512(h + i.to_bytes(4, "little")).digest()
    code = lambda b: base64.b64encode(b).decode()
    return {"algorithmName": "SHA-512", "hashValue": code(h), "saltValue": code(salt), "spinCount": str(spins), "sheet": "1"}


def _area(r1: int, c1: int, r2: int, c2: int) -> str:
    return f"{K.column_name(c1)}{r1 + 1}:{K.column_name(c2)}{r2 + 1}"


# Names of a page's settings in a file and in the writer's setup.
_SETUP = {"orientation": "orientation", "paperSize": "paper", "oddHeader": "head", "oddFooter": "foot", **{s: s for s in ("left", "right", "top", "bottom", "header", "footer")}}


def snapshot(data: bytes) -> dict:
    """All that is read of a workbook as one value: properties, names, protection, calculation, and its sheets with their
    cells, styles, layout and objects."""
    w = Workbook(data)
    sheets_ = []
    for n in w.sheets:
        cells = list(w.cells(n))
        levels = w.outlines(n)
        sheets_.append({
            "name": n, "state": w.states[n], "cells": cells, "styles": {k: w.cell_style(k) for k in sorted({c["style"] for c in cells} - {0})},
            "merges": w.merges(n), "links": w.hyperlinks(n), "widths": w.widths(n), "heights": w.heights(n), "column_outlines": levels["columns"], "row_outlines": levels["rows"],
            "freeze": w.freeze(n), "filter": w.auto_filter(n), "tab": w.tab_color(n), "lock": w.protection(n), "setup": w.page_setup(n), "comments": w.comments(n), "validations": w.validations(n),
            "formats": w.conditional_formats(n), "tables": w.tables(n), "images": w.images(n), "charts": w.charts(n), "sparklines": w.sparklines(n), "pivots": w.pivots(n),
        })
    return {"properties": w.properties(), "names": w.names(), "protection": w.protection(), "calculation": w.calculation(), "sheets": sheets_}


def from_snapshot(model: dict) -> bytes:
    """A workbook from a snapshot, whose entries may be changed or left out. A pivot's rows are taken from the cells of its
    source sheet; charts stand at the sheet's top left; a workbook's password isn't kept, only that it is locked."""
    w = Writer()
    w.properties, w.defined = dict(model.get("properties") or {}), dict(model.get("names") or {})
    w.calculation = {k.rpartition("}")[2]: v for k, v in (model.get("calculation") or {}).items()}
    w.workbook_password = "" if model.get("protection") is not None else None
    for s in model["sheets"]:
        name, rows = s["name"], w._sheet(s["name"])
        known = {k: w.style(**{a: b for a, b in {**v, "size": v.get("font_size"), "font": v.get("font_name"), "color": v.get("font_color")}.items() if b}) for k, v in (s.get("styles") or {}).items()}
        for c in s.get("cells") or ():
            rows += [""] * (c["row"] + 1 - len(rows))
            value = Formula(c["formula"], c.get("value")) if c.get("formula") else c.get("value")
            if value is not None:
                rows[c["row"]] += w.cell(f"{K.column_name(c['col'])}{c['row'] + 1}", value, known.get(c.get("style")), exact=True)
        last = max([-1, *(s.get("heights") or ()), *(s.get("row_outlines") or ())])
        rows += [""] * (last + 1 - len(rows))
        if s.get("state", "visible") != "visible":
            w.hidden.add(name)
        for key in ("widths", "heights", "links", "column_outlines", "row_outlines", "freeze", "filter", "tab", "lock"):
            if s.get(key):
                w.put(key, s[key], name)
        if setup := {_SETUP[k]: v for k, v in (s.get("setup") or {}).items() if k in _SETUP}:
            w.put("setup", setup, name)
        for m in s.get("merges") or ():
            w.put("merges", _area(*m), name)
        for key in ("comments", "validations", "tables", "charts", "sparklines"):
            for x in s.get(key) or ():
                w.put(key, x, name)
        for f in s.get("formats") or ():
            w.put("formats", {**f, "icons": len(f.get("stops") or ()) or 3}, name)
        for i in s.get("images") or ():
            w.put("images", {**i, "ext": i["name"].rpartition(".")[2].lower() or "png"}, name)
    by_name = {s["name"]: s for s in model["sheets"]}
    for s in model["sheets"]:
        for p in s.get("pivots") or ():
            source = by_name.get((p["source"] or "").rpartition("!")[0])
            if source:
                r1, c1, r2, c2 = K.range_ref(p["source"].rpartition("!")[2]) or (0, 0, 0, 0)
                found = {(c["row"], c["col"]): c["value"] for c in source["cells"]}
                grid = [[found.get((r, c)) for c in range(c1, c2 + 1)] for r in range(r1, r2 + 1)]
                w.pivot(s["name"], source["name"], grid[0], grid[1:], p["rows"], [(d["field"], d["function"].capitalize()) for d in p["data"]], p["columns"], p["filters"])
    return w.save()


def validation(v: dict) -> str:
    """ref, type and items or operator, formula1, formula2."""
    first = '"' + ",".join(v["items"]) + '"' if v.get("items") is not None else v.get("formula1")
    op = f" operator={qattr(v['operator'])}" if v.get("operator") and v.get("type") != "list" else ""
    two = f"<formula2>{esc(str(v['formula2']))}</formula2>" if v.get("formula2") is not None else ""
    one = f"<formula1>{esc(str(first))}</formula1>" if first is not None else ""
    return f'<dataValidation type={qattr(v["type"])}{op} allowBlank="1" showInputMessage="1" showErrorMessage="1" sqref={qattr(v["ref"])}>{one}{two}</dataValidation>'


def conditional(f: dict, priority: int) -> str:
    """ref, type (cellIs, dataBar, colorScale, iconSet, expression) and operator, formulas, stops, colors."""
    kind = f["type"]
    stops = "".join(f"<cfvo type={qattr(t)}{f' val={qattr(str(v))}' if v is not None else ''}/>" for t, v in f.get("stops") or ())
    colors = "".join(f'<color rgb="FF{c}"/>' for c in f.get("colors") or ())
    if kind in ("dataBar", "colorScale"):
        inner_ = f"<{kind}>{stops or '<cfvo type=\"min\"/><cfvo type=\"max\"/>'}{colors}</{kind}>"
    elif kind == "iconSet":
        n = f.get("icons", 3)
        cuts = stops or "".join(f'<cfvo type="percent" val="{round(100 * p / n)}"/>' for p in range(n))
        inner_ = f"<iconSet iconSet={qattr(f.get('icon_set', f'{n}TrafficLights1' if n == 3 else f'{n}Arrows'))}>{cuts}</iconSet>"
    else:
        inner_ = "".join(f"<formula>{esc(str(x))}</formula>" for x in f.get("formulas") or ())
    op = f" operator={qattr(f['operator'])}" if f.get("operator") else ""
    style = ' dxfId="0"' if kind in ("cellIs", "expression") else ""
    return f'<conditionalFormatting sqref={qattr(f["ref"])}><cfRule type={qattr(kind)}{style} priority="{priority}"{op}>{inner_}</cfRule></conditionalFormatting>'


def chart_xml(c: dict) -> str:
    """chart_type (bar, line, pie, area, scatter, bubble, radar, stock, surface), categories and series."""
    kind = c.get("chart_type") or "bar"
    cache = lambda tag, xs: f'<c:{tag}><c:ptCount val="{len(xs)}"/>' + "".join(f'<c:pt idx="{i}"><c:v>{esc(K.text_of(x))}</c:v></c:pt>' for i, x in enumerate(xs) if x is not None) + f"</c:{tag}>"
    body = ""
    xy = kind in ("scatter", "bubble")
    for i, s in enumerate(c["series"]):
        cats = f"<c:{'xVal' if xy else 'cat'}><c:strRef><c:f/>{cache('strCache', c.get('categories') or [])}</c:strRef></c:{'xVal' if xy else 'cat'}>"
        vals = f"<c:{'yVal' if xy else 'val'}><c:numRef><c:f/>{cache('numCache', s['values'])}</c:numRef></c:{'yVal' if xy else 'val'}>"
        body += f'<c:ser><c:idx val="{i}"/><c:order val="{i}"/><c:tx><c:strRef><c:f/>{cache("strCache", [s["name"]])}</c:strRef></c:tx>{cats}{vals}</c:ser>'
    title = f"<c:title><c:tx><c:rich><a:bodyPr/><a:p><a:r><a:t>{esc(c['title'])}</a:t></a:r></a:p></c:rich></c:tx></c:title>" if c.get("title") else ""
    head = {"bar": '<c:barDir val="col"/><c:grouping val="clustered"/>', "line": '<c:grouping val="standard"/>', "area": '<c:grouping val="standard"/>', "scatter": '<c:scatterStyle val="lineMarker"/>', "radar": '<c:radarStyle val="marker"/>'}.get(kind, "")
    axes = "" if kind == "pie" else '<c:axId val="1"/><c:axId val="2"/>'
    axis = "" if kind == "pie" else "".join(f'<c:{t}><c:axId val="{a}"/><c:scaling/><c:delete val="0"/><c:axPos val="{p}"/><c:crossAx val="{b}"/></c:{t}>' for t, a, b, p in ((("valAx" if xy else "catAx"), 1, 2, "b"), ("valAx", 2, 1, "l")))
    return f'{HEAD}<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><c:chart>{title}<c:plotArea><c:{kind}Chart>{head}{body}{axes}</c:{kind}Chart>{axis}</c:plotArea></c:chart></c:chartSpace>'


def build(sheets_: list[tuple[str, list[list]]]) -> bytes:
    w = Writer()
    for name, rows in sheets_:
        w.rows(rows, name)
    return w.save()


_FIELD = re.compile(r"\{\{(\w+)\}\}")


def fill(data: bytes, values: dict[str, str]) -> bytes:
    """{{Name}} in texts of the workbook replaced by escaped values; unknown names stay."""
    pkg = Package(data)
    parts = {}
    for n in pkg.names:
        raw = pkg.zip.read(n)
        if re.match(r"xl/(sharedStrings|worksheets/[^/]+)\.xml$", n):
            s = raw.decode("utf-8")
            raw = _FIELD.sub(lambda m: esc(values[m[1]]) if m[1] in values else m[0], s).encode()
            parse_xml(raw)
        parts[n] = raw
    return package(parts)
