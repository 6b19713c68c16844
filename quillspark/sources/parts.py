"""What a file's bytes yield, by part: rows as dictionaries, with the schema of the part."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

from .. import schema as S
from ..formats import calendar, cfb, contacts, doc, docx, epub, mail, markdown, msg, ods, pdf, pptx, registry, rtf, xls, xlsx, xps
from ..functions.kernels import text_of

Rows = Iterator[dict]


@dataclass
class Part:
    schema: str
    rows: Callable[[bytes], Rows]


def _typed(v) -> dict:
    """A cell's value as text and, where it is one, as number or time."""
    if v is None:
        return {"kind": "null"}
    if isinstance(v, bool):
        return {"kind": "boolean", "value": "true" if v else "false"}
    if isinstance(v, int | float | Decimal):
        kind = "integer" if isinstance(v, int) else "decimal" if isinstance(v, Decimal) else "double"
        return {"kind": kind, "value": text_of(v), "number": float(v)}
    if isinstance(v, dt.datetime):
        return {"kind": "datetime", "value": text_of(v), "time": v.replace(tzinfo=dt.UTC)}
    if isinstance(v, dt.timedelta):
        return {"kind": "interval", "value": text_of(v), "number": v.total_seconds()}
    return {"kind": "string", "value": v}


def _xlsx_cells(data: bytes) -> Rows:
    w = xlsx.Workbook(data)
    for name in w.sheets:
        for c in w.cells(name):
            yield {"sheet": name, "row": c["row"], "col": c["col"], "formula": c["formula"], "style": c["style"], **_typed(c["value"])}


def _grid_cells(sheets: Callable[[bytes], list]) -> Callable[[bytes], Rows]:
    def rows(data: bytes) -> Rows:
        for name, grid in sheets(data):
            for i, r in enumerate(grid):
                for j, v in enumerate(r):
                    if v not in (None, ""):
                        yield {"sheet": name, "row": i, "col": j, **_typed(v)}

    return rows


def _grid_rows(sheets: Callable[[bytes], list]) -> Callable[[bytes], Rows]:
    return lambda data: ({"sheet": n, "row": i, "cells": [None if v is None else text_of(v) for v in r]} for n, grid in sheets(data) for i, r in enumerate(grid))


def _by_sheet(method: Callable[[xlsx.Workbook, str], list[dict]]) -> Callable[[bytes], Rows]:
    def rows(data: bytes) -> Rows:
        w = xlsx.Workbook(data)
        for name in w.sheets:
            for r in method(w, name):
                yield {"sheet": name, **r}

    return rows


def _merges(ms: list[tuple]) -> list[dict]:
    return [dict(zip(("row1", "col1", "row2", "col2"), m, strict=True)) for m in ms]


def _sizes(w: xlsx.Workbook, n: str) -> list[dict]:
    levels = w.outlines(n)
    out = []
    for axis, sizes, own in (("column", w.widths(n), levels["columns"]), ("row", w.heights(n), levels["rows"])):
        out += [{"axis": axis, "index": k, "size": sizes.get(k), "outline": own.get(k, 0)} for k in sorted({*sizes, *own})]
    return out


def _sheet_info(w: xlsx.Workbook, n: str) -> list[dict]:
    freeze = w.freeze(n) or (None, None)
    return [{"state": w.states[n], "freeze_rows": freeze[0], "freeze_cols": freeze[1], "auto_filter": w.auto_filter(n), "tab_color": w.tab_color(n), "protected": w.protection(n) is not None, "page_setup": w.page_setup(n)}]


def _styles(w: xlsx.Workbook, n: str) -> list[dict]:
    known: dict[int, dict] = {}
    out = []
    for c in w.cells(n):
        style = known.setdefault(c["style"], w.cell_style(c["style"]))
        out.append({"row": c["row"], "col": c["col"], **{k: style.get(k) for k in ("number_format", "font_name", "font_size", "bold", "italic", "font_color", "fill", "horizontal", "vertical", "wrap", "underline", "border")}})
    return out


def _plain_names(attributes: dict | None) -> dict | None:
    return None if attributes is None else {k.rpartition("}")[2]: v for k, v in attributes.items()}


def _workbook(data: bytes) -> Rows:
    w = xlsx.Workbook(data)
    yield {"protection": _plain_names(w.protection()), "calculation": _plain_names(w.calculation()), "properties": w.properties(), "hidden": [n for n, s in w.states.items() if s != "visible"]}


def _sparklines(w: xlsx.Workbook, n: str) -> list[dict]:
    return [{"type": g["type"], **i} for g in w.sparklines(n) for i in g["items"]]


def _xlsx_charts(data: bytes) -> Rows:
    w = xlsx.Workbook(data)
    for n in w.sheets:
        for i, c in enumerate(w.charts(n)):
            yield {"place": n, "chart_number": i + 1, **c}


def _xlsx_images(data: bytes) -> Rows:
    w = xlsx.Workbook(data)
    for n in w.sheets:
        for i in w.images(n):
            yield {"place": n, **i}


def _slides(data: bytes) -> Rows:
    d = pptx.Deck(data)
    for k in range(len(d.slides)):
        yield {"slide": k, "text": d.slide_text(k), "notes": d.notes(k), "transition": d.transition(k)}


def _shapes(data: bytes) -> Rows:
    d = pptx.Deck(data)
    for k in range(len(d.slides)):
        yield from ({"slide": k, **s} for s in _with_children(d.shapes(k), None))


def _with_children(shapes: list[dict], parent: int | None) -> Rows:
    for s in shapes:
        yield {**s, "parent": parent}
        yield from _with_children(s["children"], s["id"])


def _deck_parts(data: bytes) -> Rows:
    d = pptx.Deck(data)
    for kind in ("slides", "slideMasters", "slideLayouts", "theme"):
        names = [None] * len(d.slides) if kind == "slides" else d.names(kind)
        yield from ({"kind": kind, "number": k, "name": n, "xml": d.part_xml(kind, k)} for k, n in enumerate(names))


def _slide_comments(data: bytes) -> Rows:
    d = pptx.Deck(data)
    return ({"slide": k, **c} for k in range(len(d.slides)) for c in d.comments(k))


def _pptx_charts(data: bytes) -> Rows:
    d = pptx.Deck(data)
    for k in range(len(d.slides)):
        for c in d.charts(k):
            yield {"place": str(k), **c}


def _pptx_tables(data: bytes) -> Rows:
    d = pptx.Deck(data)
    idx = 0
    for k in range(len(d.slides)):
        for s in d.shapes(k):
            if s["rows"] is not None:
                yield from ({"idx": idx, "row": i, "cells": r} for i, r in enumerate(s["rows"]))
                idx += 1


def _doc_tables(tables: Callable[[bytes], list]) -> Callable[[bytes], Rows]:
    return lambda data: ({"idx": k, "row": i, "cells": r} for k, t in enumerate(tables(data)) for i, r in enumerate(t))


def _paragraphs(texts: Callable[[bytes], list[str]]) -> Callable[[bytes], Rows]:
    return lambda data: ({"idx": k, "text": t} for k, t in enumerate(texts(data)))


def _blocks(data: bytes) -> Rows:
    for k, b in enumerate(docx.Document(data).blocks()):
        if b["kind"] == "table":
            b = {**b, "rows": [["\n".join(docx.plain(x) for x in c["blocks"]) for c in r] for r in b["rows"]]}
        yield {"idx": k, **b}


def _marginals(data: bytes) -> Rows:
    d = docx.Document(data)
    for kind, texts in {**d.headers(), **d.notes()}.items():
        yield from ({"kind": kind, "idx": k, "text": t} for k, t in enumerate(texts))


def _markdown_tables(data: bytes) -> list[list[list[str]]]:
    tree = markdown.parse(data.decode("utf-8", "replace"))
    out = []

    def walk(n: dict) -> None:
        if n["kind"] == "table":
            out.append([[markdown.plain(c) for c in r["children"]] for r in n["children"]])
        for c in n.get("children", ()):
            walk(c)

    walk(tree)
    return out


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _pages(data: bytes) -> Rows:
    return ({"page": k, "text": t} for k, t in enumerate(pdf.Document(data).page_texts()))


def _xps_glyphs(data: bytes) -> Rows:
    return ({"page": k, **g} for k, p in enumerate(xps.parse(data)["pages"]) for g in p["glyphs"])


def _named(found: Callable[[bytes], list[tuple[str, bytes]]]) -> Callable[[bytes], Rows]:
    return lambda data: ({"name": n, "data": d} for n, d in found(data))


PARTS: dict[str, Part] = {
    "xlsx.cells": Part(S.CELL, _xlsx_cells),
    "xlsx.rows": Part(S.SHEET_ROW, _grid_rows(xlsx.sheets)),
    "xlsx.merges": Part(S.MERGE, _by_sheet(lambda w, n: _merges(w.merges(n)))),
    "xlsx.links": Part(S.LINK, _by_sheet(lambda w, n: [{"ref": r, "url": u} for r, u in w.hyperlinks(n).items()])),
    "xlsx.sizes": Part(S.SIZE, _by_sheet(_sizes)),
    "xlsx.sheets": Part(S.SHEET_INFO, _by_sheet(_sheet_info)),
    "xlsx.styles": Part(S.STYLE, _by_sheet(_styles)),
    "xlsx.comments": Part(S.COMMENT, _by_sheet(xlsx.Workbook.comments)),
    "xlsx.validations": Part(S.VALIDATION, _by_sheet(xlsx.Workbook.validations)),
    "xlsx.formats": Part(S.FORMAT, _by_sheet(xlsx.Workbook.conditional_formats)),
    "xlsx.tables": Part(S.TABLE, _by_sheet(xlsx.Workbook.tables)),
    "xlsx.charts": Part(S.CHART, _xlsx_charts),
    "xlsx.sparklines": Part(S.SPARKLINE, _by_sheet(_sparklines)),
    "xlsx.workbook": Part(S.WORKBOOK, _workbook),
    "xlsx.images": Part(S.IMAGE, _xlsx_images),
    "xlsx.pivots": Part(S.PIVOT, _by_sheet(xlsx.Workbook.pivots)),
    "xlsx.names": Part(S.NAME, lambda d: ({"name": k, "formula": v} for k, v in xlsx.Workbook(d).names().items())),
    "xlsx.other": Part(S.PART, lambda d: ({"part": p} for p in xlsx.Workbook(d).other_parts())),
    "xls.cells": Part(S.CELL, _grid_cells(xls.sheets)),
    "xls.rows": Part(S.SHEET_ROW, _grid_rows(xls.sheets)),
    "xls.links": Part(S.LINK, lambda d: ({"sheet": n, "ref": r, "url": u} for w in [xls.Workbook(d)] for n in w.sheets for r, u in w.hyperlinks(n).items())),
    "xls.sizes": Part(S.SIZE, lambda d: ({"sheet": n, "axis": "column", "index": c, "size": s, "outline": 0} for w in [xls.Workbook(d)] for n in w.sheets for c, s in w.widths(n).items())),
    "xls.merges": Part(S.MERGE, lambda d: ({"sheet": n, **m} for w in [xls.Workbook(d)] for n in w.sheets for m in _merges(w.merges(n)))),
    "ods.cells": Part(S.CELL, _grid_cells(ods.sheets)),
    "ods.rows": Part(S.SHEET_ROW, _grid_rows(ods.sheets)),
    "ods.merges": Part(S.MERGE, lambda d: ({"sheet": s["name"], **m} for s in ods.parse(d) for m in _merges(s["merges"]))),
    "docx.paragraphs": Part(S.PARAGRAPH, _paragraphs(lambda d: docx.Document(d).paragraphs())),
    "docx.tables": Part(S.DOC_TABLE, _doc_tables(lambda d: docx.Document(d).tables())),
    "docx.blocks": Part(S.BLOCK, _blocks),
    "docx.marginals": Part(S.MARGINAL, _marginals),
    "docx.images": Part(S.FILE, _named(lambda d: docx.Document(d).images())),
    "docx.properties": Part(S.PROPERTIES, lambda d: iter([{"properties": docx.Document(d).properties()}])),
    "doc.paragraphs": Part(S.PARAGRAPH, _paragraphs(doc.paragraphs)),
    "doc.tables": Part(S.DOC_TABLE, _doc_tables(doc.tables)),
    "pptx.slides": Part(S.SLIDE, _slides),
    "pptx.shapes": Part(S.SHAPE, _shapes),
    "pptx.tables": Part(S.DOC_TABLE, _pptx_tables),
    "pptx.parts": Part(S.DECK_PART, _deck_parts),
    "pptx.comments": Part(S.SLIDE_COMMENT, _slide_comments),
    "pptx.charts": Part(S.CHART, _pptx_charts),
    "pptx.images": Part(S.FILE, _named(lambda d: pptx.Deck(d).images())),
    "ppt.slides": Part(S.SLIDE, lambda d: ({"slide": k, "text": t} for k, t in enumerate(doc.slide_texts(d)))),
    "pdf.pages": Part(S.PAGE, _pages),
    "pdf.glyphs": Part(S.GLYPH, lambda d: pdf.Document(d).glyphs()),
    "pdf.tables": Part(S.DOC_TABLE, _doc_tables(pdf.tables)),
    "pdf.info": Part(S.PDF_INFO, lambda d: iter([{**(p := pdf.Document(d)).metadata(), "fonts": p.fonts()}])),
    "pdf.annotations": Part(S.ANNOTATION, lambda d: iter(pdf.Document(d).annotations())),
    "pdf.fields": Part(S.FIELD, lambda d: iter(pdf.Document(d).fields())),
    "pdf.bookmarks": Part(S.BOOKMARK, lambda d: ({"ord": k, **b} for k, b in enumerate(pdf.Document(d).bookmarks()))),
    "pdf.images": Part(S.FILE, lambda d: ({"name": str(i["number"]), "data": i["data"]} for i in pdf.Document(d).images())),
    "pdf.attachments": Part(S.FILE, lambda d: iter(pdf.Document(d).attachments())),
    "eml.messages": Part(S.MAIL, lambda d: iter([mail.parse(d)])),
    "msg.messages": Part(S.MAIL, lambda d: iter([msg.parse(d)])),
    "ics.events": Part(S.EVENT, lambda d: iter(calendar.parse(_text(d))["events"])),
    "ics.todos": Part(S.TODO, lambda d: iter(calendar.parse(_text(d))["todos"])),
    "vcf.contacts": Part(S.CONTACT, lambda d: iter(contacts.parse(_text(d)))),
    "epub.chapters": Part(S.CHAPTER, lambda d: ({"idx": k, **c} for k, c in enumerate(epub.parse(d)["chapters"]))),
    "epub.properties": Part(S.PROPERTIES, lambda d: iter([{"properties": {k: v for k, v in epub.parse(d).items() if isinstance(v, str)}}])),
    "xps.pages": Part(S.PAGE, lambda d: ({"page": k, "text": p["text"]} for k, p in enumerate(xps.parse(d)["pages"]))),
    "xps.glyphs": Part(S.GLYPH, _xps_glyphs),
    "xps.images": Part(S.FILE, _named(xps.images)),
    "xps.properties": Part(S.PROPERTIES, lambda d: iter([{"properties": xps.parse(d)["properties"]}])),
    "rtf.paragraphs": Part(S.PARAGRAPH, _paragraphs(lambda d: [rtf.paragraph_text(b) for b in rtf.parse(d)["blocks"] if b["kind"] == "paragraph"])),
    "rtf.tables": Part(S.DOC_TABLE, _doc_tables(lambda d: rtf.tables(rtf.parse(d)))),
    "rtf.properties": Part(S.PROPERTIES, lambda d: iter([{"properties": rtf.parse(d)["info"]}])),
    "md.nodes": Part(S.NODE, lambda d: iter(markdown.flat(markdown.parse(_text(d))))),
    "md.tables": Part(S.DOC_TABLE, _doc_tables(_markdown_tables)),
    "cfb.streams": Part(S.STREAM, lambda d: ({"stream_path": p, "data": b} for p, b in cfb.parse(d).walk())),
}

DEFAULTS = {f: next(k for k in PARTS if k.startswith(f + ".")).partition(".")[2] for f in [*registry.FORMATS, "msg", "cfb"]}
