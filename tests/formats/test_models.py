"""Snapshots of workbooks, layout of converted documents, flowing PDFs, and edits of models."""

import datetime as dt

import pytest

from quillspark.formats import convert, docx, markdown, pdf, pptx, xlsx
from quillspark.sources.parts import PARTS

JPEG = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x02\x00\x03\x03\xff\xd9"


def workbook() -> bytes:
    w = xlsx.Writer()
    bold = w.style(bold=True, fill="FF0000", border={"top": "thin"}, vertical="top", horizontal="center", wrap=True)
    w.row(["id", "share", "text", "long"], "One", [bold] * 4)
    w.row([1, "12.5%", "x", 123456789012], "One")
    w.row([dt.datetime(2024, 1, 2, 3, 4, 5), True, xlsx.Formula("A2*2", 2), 2.5], "One")
    w.row(["hidden"], "Two")
    w.hidden.add("Two")
    for key, value in (
        ("merges", "B2:C3"), ("freeze", (1, 2)), ("filter", "A1:D3"), ("tab", "00FF00"), ("widths", {0: 20.0}), ("heights", {5: 30.0}), ("row_outlines", {1: 2}), ("links", {"A1": "https://example.com"}),
        ("comments", {"ref": "A1", "author": "me", "text": "note"}), ("validations", {"ref": "A2", "type": "list", "items": ["a", "b"]}), ("formats", {"ref": "A1:A3", "type": "cellIs", "operator": "greaterThan", "formulas": ["1"]}),
        ("tables", {"name": "T", "ref": "A1:D3", "columns": ["id", "share", "text", "long"]}), ("images", {"data": b"png", "row": 3, "col": 1, "ext": "png"}), ("charts", {"chart_type": "line", "categories": ["a"], "series": [{"name": "s", "values": [1.0]}]}),
        ("sparklines", {"type": "column", "items": [{"formula": "One!A1:B1", "ref": "E1"}]}), ("setup", {"orientation": "landscape", "head": "top"}), ("lock", xlsx.lock_attributes("pw", b"salt", 10)),
    ):
        w.put(key, value, "One")
    w.defined["N"] = "One!$A$1"
    w.calculation = {"calcMode": "manual"}
    w.properties["title"] = "T"
    w.workbook_password = ""
    w.pivot("Two", "One", ["id", "share"], [[1, 2], [3, 4]], ["id"], [("share", "Sum")])
    return w.save()


def test_snapshot_is_written_as_it_was_read():
    data = workbook()
    model = xlsx.snapshot(data)
    again = xlsx.snapshot(xlsx.from_snapshot(model))
    assert {k: v for k, v in again.items() if k != "sheets"} == {k: v for k, v in model.items() if k != "sheets"}
    for a, b in zip(model["sheets"], again["sheets"], strict=True):
        plain = lambda s: [(c["row"], c["col"], c["value"], c["formula"]) for c in s["cells"]]
        assert plain(a) == plain(b)
        style = lambda s: [{k: v for k, v in s["styles"].get(c["style"], {}).items() if k != "number_format_id"} for c in s["cells"] if c["row"] == 0]
        assert style(a) == style(b)
        for key in set(a) - {"cells", "styles", "pivots", "formats"}:
            assert a[key] == b[key], key
        assert [(f["ref"], f["type"], f["formulas"]) for f in a["formats"]] == [(f["ref"], f["type"], f["formulas"]) for f in b["formats"]]
    assert [p["rows"] for p in again["sheets"][1]["pivots"]] == [p["rows"] for p in model["sheets"][1]["pivots"]] == [["id"]]


def test_snapshot_keeps_texts_and_numbers():
    model = {"sheets": [{"name": "S", "cells": [{"row": 2, "col": 1, "value": "12%"}, {"row": 2, "col": 3, "value": 123456789012345}]}]}
    cells = xlsx.snapshot(xlsx.from_snapshot(model))["sheets"][0]["cells"]
    assert [(c["row"], c["col"], c["value"]) for c in cells] == [(2, 1, "12%"), (2, 3, 123456789012345)]


def test_sheet_parts():
    data = workbook()
    one = lambda part: list(PARTS[part].rows(data))
    assert one("xlsx.sparklines") == [{"sheet": "One", "type": "column", "formula": "One!A1:B1", "ref": "E1"}]
    book = one("xlsx.workbook")[0]
    assert book["protection"] == {"lockStructure": "1"} and book["calculation"] == {"calcMode": "manual"} and book["hidden"] == ["Two"] and book["properties"] == {"title": "T"}
    first = one("xlsx.styles")[0]
    assert (first["vertical"], first["wrap"], first["border"], first["fill"]) == ("top", True, {"top": "thin"}, "FF0000")


def test_word_model():
    w = docx.Writer().footnote("see", "a note").table([["a"], ["b"]], lines=docx.borders("double", "FF0000", 8, inside=False))
    w.section["header"] = "top"
    data = w.save()
    assert [(r["kind"], r["text"]) for r in PARTS["docx.marginals"].rows(data)] == [("header", "top"), ("footnote", "a note")]
    assert [b["rows"] for b in PARTS["docx.blocks"].rows(data) if b["kind"] == "table"] == [[["a"], ["b"]]]
    body = docx.Document(data).pkg.read("word/document.xml").decode()
    assert 'w:top w:val="double" w:sz="8" w:space="0" w:color="FF0000"' in body and 'w:insideH w:val="none"' in body


def test_word_as_pdf():
    data = docx.Writer().heading("Title", 1).paragraph("body " * 60).paragraph("").table([["h", "i"], ["1", "2"]]).save()
    d = pdf.Document(convert.docx_to_pdf(data))
    glyphs = list(d.glyphs())
    assert (glyphs[0]["text"], glyphs[0]["font_size"]) == ("Title", 22)
    body = [g for g in glyphs if g["text"].startswith("body")]
    assert len(body) > 1 and {g["font_size"] for g in body} == {11} and " ".join(g["text"] for g in body).split() == ["body"] * 60
    assert pdf.tables(convert.docx_to_pdf(data)) == [[["h", "i"], ["1", "2"]]]


def test_deck_as_pdf():
    w = pptx.Writer()
    k = w.slide()
    w.text(k, "lower", y=900_000)
    w.text(k, "upper", y=100)
    w.text(k, "upper", y=950_000)
    w.table(k, [["a", "b"]])
    w.slide()
    d = pdf.Document(convert.pptx_to_pdf(w.save(), title="T", numbered=True))
    assert [t.split("\n") for t in d.page_texts()] == [["upper", "lower", "ab", "1 / 2"], ["幻灯片 2", "2 / 2"]]
    assert d.metadata()["title"] == "T"


def test_flow():
    out = pdf.Flow(200, 80, 20)
    out.text("wwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwwww and words that wrap", 10).gap(5).component(lambda w: w.line_of("drawn"))
    texts = pdf.Document(out.save()).page_texts()
    assert "".join("".join(texts).split()) == "w" * 40 + "andwordsthatwrapdrawn" and len(texts) > 1
    assert all(pdf.text_width(line, 10) <= 160 for t in texts for line in t.split("\n"))


def test_fields_opacity_and_overlay():
    w = pdf.Writer().field("Tx", "a", 0, 0, 1, 1, "old").opacity(0.5)
    assert w.set_field("a", "new") and not w.set_field("b", "x")
    d = pdf.Document(w.save())
    assert d.fields()[0]["value"] == "new" and b"/G1 gs" in d.contents(d.pages()[0])
    stamped = pdf.Document(pdf.overlaid_image(pdf.build(["line"]), JPEG, 0, 0, 10, 10, 0.3))
    assert stamped.page_texts() == ["line"] and len(stamped.images()) == 1
    with pytest.raises(NotImplementedError):
        pdf.images_of_pages(b"")


def test_content_operators():
    ops = [([], b"q"), ([1, -0.5, pdf.Name("a b#"), b"(x)\\", [b"k", -20, 3], {"K": True, "N": None}], b"Do"), ([pdf.Name("F1"), 12], b"Tf")]
    assert list(pdf.operators(pdf.operator_bytes(ops))) == ops
    page = pdf.Document(pdf.build(["line one", "two"]))
    own = list(pdf.operators(page.contents(page.pages()[0])))
    assert own and list(pdf.operators(pdf.operator_bytes(own))) == own


def test_inline_factories():
    M = markdown
    p = M.paragraph_of("a*b ", M.strong("s"), " ", M.emphasis("e"), " ", M.strong_emphasis("se"), " ", M.strike("x"), " ", M.code("c`d"), " ", M.link("l", "u", "t"), " ", M.image("i", "v"), M.line_break(), "z ", M.html_inline("<br>"), "!")
    written = M.markdown(M.document(p))
    again = M.parse(written)["children"][0]
    assert [n["kind"] for n in again["children"]] == [n["kind"] for n in p["children"]]
    assert M.plain(again) == M.plain(p) == "a*b s e se x c`d l i\nz !"


def test_deck_tables_and_layouts():
    rows = pptx.table_row([["h", "i"], ["1"]], ["2", "3"])
    assert pptx.table_without(rows, 9) == rows and pptx.table_without(rows, 1) == [["h", "i"], ["2", "3"]]
    assert pptx.table_column(rows, 1, "new") == [["h", "new", "i"], ["1", ""], ["2", "", "3"]]
    w = pptx.Writer()
    assert w.layout("Mine", "title") == 1
    assert [(p["kind"], p["name"]) for p in PARTS["pptx.parts"].rows(w.save())] == [("slideMasters", "Master"), ("slideLayouts", "Blank"), ("slideLayouts", "Mine"), ("theme", None)]


def test_grouped_shapes():
    w = pptx.Writer()
    k = w.slide()
    w.text(k, "a")
    w.text(k, "b")
    w.group(k, 0, 1)
    assert [(s["shape_type"], s["parent"], s["text"]) for s in PARTS["pptx.shapes"].rows(w.save())] == [("group", None, ""), ("shape", 900, "a"), ("shape", 900, "b")]
