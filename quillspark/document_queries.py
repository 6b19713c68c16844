"""Queries over parts of documents: each builds documents from a table's rows and reads one of their parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formats import cfb, convert, crypto, docx, mail, markdown, pdf, pptx, rtf, xlsx
from .functions import kernels as K
from .queries import query, table
from .sinks import documents
from .sources import extract, read_records
from .sources.files import extract_markdown, extract_text

PER = 100  # rows of a document
JPEG = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x02\x00\x03\x03\xff\xd9"


def built(spark, sf_dir: str, name: str, key: str, columns: list[str], fmt: str, build: Callable[[list[dict]], bytes]) -> DataFrame:
    """file, name and content: a document of each PER keys, made from rows of i (the key's place), key and columns."""
    rows = table(spark, sf_dir, name).select(F.floor(F.col(key) / PER).alias("file"), (F.col(key) % PER).cast("int").alias("i"), F.col(key).alias("k"), *columns)
    return documents(rows, "file", fmt, ["i", "k", *columns], "i", build)


def part_query(name: str, sql: str, source: tuple[str, str, list[str]], fmt: str, part: str, select: list[str], build: Callable[[list[dict]], bytes]) -> None:
    def run(spark, sf_dir):
        return extract(built(spark, sf_dir, *source, fmt, build), part, ["file"]).selectExpr("file", *(f"`{c}`" if c.isidentifier() else c for c in select))

    run.__name__ = name
    query(sql)(run)


def text_query(name: str, sql: str, source: tuple[str, str, list[str]], fmt: str, build: Callable[[list[dict]], bytes], read=extract_text) -> None:
    """The text of each document as it is read by its extension."""

    def run(spark, sf_dir):
        return built(spark, sf_dir, *source, fmt, build).select("file", read("content", F.lit(fmt)).alias("text"))

    run.__name__ = name
    query(sql)(run)


PARTS = ("part", "p_partkey", ["p_name", "p_size"])
NATIONS = ("nation", "n_nationkey", ["n_name"])
_P = "p_partkey // 100 AS file"
_PI = "(p_partkey % 100)"
_N = "n_nationkey // 100 AS file"
_LISTED = "string_agg(n_name, chr(10) ORDER BY n_nationkey)"


# Sheets ------------------------------------------------------------------------------------------------------


def sheet(put: Callable[[xlsx.Writer, dict], None], row: Callable[[dict], list] = lambda r: [r["k"]]) -> Callable[[list[dict]], bytes]:
    """A workbook with a row for each of the rows, and what put adds for it."""

    def build(rows: list[dict]) -> bytes:
        w = xlsx.Writer()
        for r in rows:
            w.row(row(r), "S")
            put(w, r)
        return w.save()

    return build


part_query("sheet_merges", f"SELECT {_P}, {_PI}::INT * 2 AS row1, 1 AS col1, {_PI}::INT * 2 + 1 AS row2, 3 AS col2 FROM part", PARTS, "xlsx", "xlsx.merges", ["row1", "col1", "row2", "col2"], sheet(lambda w, r: w.put("merges", f"B{2 * r['i'] + 1}:D{2 * r['i'] + 2}")))
part_query("sheet_comments", f"SELECT {_P}, 'A' || ({_PI} + 1) AS ref, 'size ' || p_size AS author, p_name AS text FROM part", PARTS, "xlsx", "xlsx.comments", ["ref", "author", "text"], sheet(lambda w, r: w.put("comments", {"ref": f"A{r['i'] + 1}", "author": f"size {r['p_size']}", "text": r["p_name"]})))
part_query("sheet_links", f"SELECT {_P}, 'B' || ({_PI} + 1) AS ref, CASE WHEN p_size % 2 = 0 THEN 'https://example.com/' || p_partkey ELSE '#S!A' || p_size END AS url FROM part", PARTS, "xlsx", "xlsx.links", ["ref", "url"], sheet(lambda w, r: w.put("links", {f"B{r['i'] + 1}": f"#S!A{r['p_size']}" if r["p_size"] % 2 else f"https://example.com/{r['k']}"})))
part_query("sheet_validations", f"SELECT {_P}, 'A' || ({_PI} + 1) AS ref, 'whole' AS type, 'between' AS operator, '1' AS formula1, p_size::VARCHAR AS formula2 FROM part", PARTS, "xlsx", "xlsx.validations", ["ref", "type", "operator", "formula1", "formula2"], sheet(lambda w, r: w.put("validations", {"ref": f"A{r['i'] + 1}", "type": "whole", "operator": "between", "formula1": 1, "formula2": r["p_size"]})))
part_query("sheet_dropdowns", f"SELECT {_P}, 'A' || ({_PI} + 1) AS ref, ['all', 's' || p_size] AS items FROM part", PARTS, "xlsx", "xlsx.validations", ["ref", "items"], sheet(lambda w, r: w.put("validations", {"ref": f"A{r['i'] + 1}", "type": "list", "items": ["all", f"s{r['p_size']}"]})))
part_query("sheet_formats", f"SELECT {_P}, 'A' || ({_PI} + 1) AS ref, 'cellIs' AS type, 'greaterThan' AS operator, [p_size::VARCHAR] AS formulas FROM part", PARTS, "xlsx", "xlsx.formats", ["ref", "type", "operator", "formulas"], sheet(lambda w, r: w.put("formats", {"ref": f"A{r['i'] + 1}", "type": "cellIs", "operator": "greaterThan", "formulas": [r["p_size"]]})))


def _sized(w: xlsx.Writer, r: dict) -> None:
    w.put("heights", {r["i"]: 10.0 + r["p_size"]})
    w.put("row_outlines", {r["i"]: r["i"] % 3 + 1})
    w.put("widths", {r["i"]: 20.0})


part_query("sheet_sizes", f"SELECT {_P}, 'row' AS axis, {_PI}::INT AS \"index\", 10.0::DOUBLE + p_size AS size, {_PI}::INT % 3 + 1 AS outline FROM part UNION ALL SELECT {_P}, 'column', {_PI}::INT, 20.0::DOUBLE, 0 FROM part", PARTS, "xlsx", "xlsx.sizes", ["axis", "index", "size", "outline"], sheet(_sized))


def _styled(rows: list[dict]) -> bytes:
    w = xlsx.Writer()
    for r in rows:
        odd = r["p_size"] % 2 == 1
        style = w.style(bold=odd, wrap=odd, italic=not odd, size=8 + r["p_size"] % 5, fill="FFCC00" if odd else None, border={"top": "thin"} if odd else "thick", vertical="center", horizontal="right", number_format="0.0")
        w.row([r["k"]], "S", [style])
    return w.save()


part_query(
    "sheet_styles", f"SELECT {_P}, {_PI}::INT AS \"row\", p_size % 2 = 1 AS bold, p_size % 2 = 0 AS italic, (8 + p_size % 5)::DOUBLE AS font_size, CASE WHEN p_size % 2 = 1 THEN 'FFCC00' END AS fill, p_size % 2 = 1 AS wrap, 'center' AS vertical, 'right' AS horizontal, '0.0' AS number_format FROM part",
    PARTS, "xlsx", "xlsx.styles", ["row", "bold", "italic", "font_size", "fill", "wrap", "vertical", "horizontal", "number_format"], _styled,
)
part_query("sheet_formulas", f"SELECT {_P}, 'A1*' || p_size AS formula, (2 * p_size)::DOUBLE AS number FROM part", PARTS, "xlsx", "xlsx.cells", ["formula", "number"], sheet(lambda w, r: None, lambda r: [xlsx.Formula(f"=A1*{r['p_size']}", 2 * r["p_size"])]))
part_query("sheet_names", f"SELECT {_P}, 'N' || p_partkey AS name, 'S!$A$' || p_size AS formula FROM part", PARTS, "xlsx", "xlsx.names", ["name", "formula"], sheet(lambda w, r: w.defined.update({f"N{r['k']}": f"S!$A${r['p_size']}"})))


def _sheets(rows: list[dict]) -> bytes:
    w = xlsx.Writer()
    for r in rows:
        w.row([r["n_name"]], r["n_name"])
        for key, value in (("freeze", (r["i"] + 1, 2)), ("filter", f"A1:B{r['i'] + 2}"), ("tab", "00AAFF"), ("setup", {"orientation": "landscape", "head": r["n_name"]})):
            w.put(key, value, r["n_name"])
        if r["i"] % 2:
            w.put("lock", {"sheet": "1"}, r["n_name"])
            w.hidden.add(r["n_name"])
    w.calculation = {"calcMode": "manual"}
    w.workbook_password = ""
    return w.save()


@query(f"SELECT {_N}, n_name AS sheet, CASE WHEN n_nationkey % 2 = 1 THEN 'hidden' ELSE 'visible' END AS state, n_nationkey::INT + 1 AS freeze_rows, 2 AS freeze_cols, 'A1:B' || (n_nationkey + 2) AS auto_filter, '00AAFF' AS tab_color, n_nationkey % 2 = 1 AS protected, 'landscape' AS orientation, n_name AS header FROM nation")
def sheet_infos(spark, sf_dir):
    got = extract(built(spark, sf_dir, *NATIONS, "xlsx", _sheets), "xlsx.sheets", ["file"])
    return got.select("file", "sheet", "state", "freeze_rows", "freeze_cols", "auto_filter", "tab_color", "protected", F.col("page_setup")["orientation"].alias("orientation"), F.col("page_setup")["oddHeader"].alias("header"))


@query(f"SELECT {_N}, '1' AS locked, 'manual' AS calculation, list(n_name ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 1) AS hidden FROM nation GROUP BY 1")
def workbook_settings(spark, sf_dir):
    got = extract(built(spark, sf_dir, *NATIONS, "xlsx", _sheets), "xlsx.workbook", ["file"])
    return got.select("file", F.col("protection")["lockStructure"].alias("locked"), F.col("calculation")["calcMode"].alias("calculation"), "hidden")


def _objects(w: xlsx.Writer, r: dict) -> None:
    w.put("charts", {"chart_type": "line", "categories": ["a", "b"], "series": [{"name": r["n_name"], "values": [r["k"], 2 * r["k"]]}]})
    w.put("sparklines", {"type": "column", "items": [{"formula": f"S!A1:C{r['i'] + 1}", "ref": f"D{r['i'] + 1}"}]})
    w.put("tables", {"name": f"T{r['k']}", "ref": f"A{r['i'] + 1}:B{r['i'] + 1}", "columns": ["x", r["n_name"]]})
    w.put("images", {"data": r["n_name"].encode(), "row": r["i"], "col": 3, "ext": "png"})


@query(f"SELECT {_N}, 'line' AS chart_type, ['a', 'b'] AS categories, n_name AS name, [n_nationkey::DOUBLE, 2.0::DOUBLE * n_nationkey] AS points FROM nation")
def sheet_charts(spark, sf_dir):
    got = extract(built(spark, sf_dir, *NATIONS, "xlsx", sheet(_objects)), "xlsx.charts", ["file"])
    return got.select("file", "chart_type", "categories", F.inline("series")).select("file", "chart_type", "categories", "name", F.col("values").alias("points"))


part_query("sheet_sparklines", f"SELECT {_N}, 'column' AS type, 'D' || (n_nationkey + 1) AS ref, 'S!A1:C' || (n_nationkey + 1) AS formula FROM nation", NATIONS, "xlsx", "xlsx.sparklines", ["type", "ref", "formula"], sheet(_objects))
part_query("sheet_tables", f"SELECT {_N}, 'T' || n_nationkey AS name, 'A' || (n_nationkey + 1) || ':B' || (n_nationkey + 1) AS ref, ['x', n_name] AS columns FROM nation", NATIONS, "xlsx", "xlsx.tables", ["name", "ref", "columns"], sheet(_objects))
part_query("sheet_images", f"SELECT {_N}, n_nationkey::INT AS \"row\", 3 AS col, n_name AS data FROM nation", NATIONS, "xlsx", "xlsx.images", ["row", "col", "cast(data as string) as data"], sheet(_objects))


def _copied(rows: list[dict]) -> bytes:
    return xlsx.from_snapshot(xlsx.snapshot(sheet(lambda w, r: w.put("comments", {"ref": f"A{r['i'] + 1}", "author": "x", "text": r["p_name"]}), lambda r: [r["k"], r["p_name"], r["p_size"]])(rows)))


part_query("sheet_snapshot", f"SELECT {_P}, [p_partkey::VARCHAR, p_name, p_size::VARCHAR] AS cells FROM part", PARTS, "xlsx", "xlsx.rows", ["cells"], _copied)
part_query("sheet_snapshot_comments", f"SELECT {_P}, 'A' || ({_PI} + 1) AS ref, p_name AS text FROM part", PARTS, "xlsx", "xlsx.comments", ["ref", "text"], _copied)
part_query("sheet_encrypted", f"SELECT {_N}, [n_nationkey::VARCHAR, n_name] AS cells FROM nation", NATIONS, "xlsx", "xlsx.rows", ["cells"], lambda rows: crypto.decrypt_package(crypto.encrypt_package(xlsx.build([("S", [[r["k"], r["n_name"]] for r in rows])]), "pw", 1000), "pw"))


# Word --------------------------------------------------------------------------------------------------------


def word(put: Callable[[docx.Writer, dict], object]) -> Callable[[list[dict]], bytes]:
    def build(rows: list[dict]) -> bytes:
        w = docx.Writer()
        w.section["header"], w.section["footer"] = "head", f"{len(rows)} rows"
        w.properties = {"title": f"file of {len(rows)}"}
        for r in rows:
            put(w, r)
        return w.save()

    return build


part_query("word_headings", f"SELECT {_P}, {_PI}::INT AS idx, (1 + p_size % 6)::INT AS level, p_name AS text FROM part", PARTS, "docx", "docx.blocks", ["idx", "level", "text"], word(lambda w, r: w.heading(r["p_name"], 1 + r["p_size"] % 6)))


@query(f"SELECT {_P}, p_name AS text, p_size % 2 = 1 AS bold, p_size % 3 = 0 AS italic, 'FF0000' AS color, 9.5::DOUBLE AS size FROM part")
def word_runs(spark, sf_dir):
    docs = built(spark, sf_dir, *PARTS, "docx", word(lambda w, r: w.paragraph([{"text": r["p_name"], "bold": r["p_size"] % 2 == 1, "italic": r["p_size"] % 3 == 0, "color": "FF0000", "size": 9.5}])))
    return extract(docs, "docx.blocks", ["file"]).select("file", F.inline("runs")).select("file", "text", "bold", "italic", "color", "size")


@query(f"SELECT {_N}, n_name AS text, 'https://example.com/' || n_nationkey AS link FROM nation")
def word_links(spark, sf_dir):
    docs = built(spark, sf_dir, *NATIONS, "docx", word(lambda w, r: w.hyperlink(r["n_name"], f"https://example.com/{r['k']}")))
    return extract(docs, "docx.blocks", ["file"]).select("file", F.inline("runs")).select("file", "text", "link")


part_query("word_controls", f"SELECT {_N}, 'control' AS kind, n_name AS alias FROM nation", NATIONS, "docx", "docx.blocks", ["kind", "alias"], word(lambda w, r: w.control("text", "v", r["n_name"])))
part_query("word_table_blocks", f"SELECT {_N}, [['key', n_name], [n_nationkey::VARCHAR, 'x']] AS \"rows\" FROM nation", NATIONS, "docx", "docx.blocks", ["rows"], word(lambda w, r: w.table([["key", r["n_name"]], [r["k"], "x"]], lines=docx.borders(inside=False))))
part_query("word_marginals", f"SELECT {_N}, 'footnote' AS kind, n_nationkey::INT AS idx, n_name AS text FROM nation UNION ALL SELECT file, unnest(['header', 'footer']), 0, unnest(['head', n || ' rows']) FROM (SELECT {_N}, count(*) AS n FROM nation GROUP BY 1)", NATIONS, "docx", "docx.marginals", ["kind", "idx", "text"], word(lambda w, r: w.footnote("see", r["n_name"])))
part_query("word_images", f"SELECT {_N}, 'word/media/image' || (n_nationkey + 1) || '.png' AS name FROM nation", NATIONS, "docx", "docx.images", ["name"], word(lambda w, r: w.image(r["n_name"].encode())))


@query(f"SELECT {_N}, 'file of ' || count(*) AS title FROM nation GROUP BY 1")
def word_properties(spark, sf_dir):
    got = extract(built(spark, sf_dir, *NATIONS, "docx", word(lambda w, r: w.paragraph(r["n_name"]))), "docx.properties", ["file"])
    return got.select("file", F.col("properties")["title"].alias("title"))


@query("SELECT p_partkey, p_size, p_name AS name FROM part")
def word_records(spark, sf_dir):
    docs = built(spark, sf_dir, *PARTS, "docx", lambda rows: docx.Writer().table([["Name", "P_Size", "P_PartKey"], *[[r["p_name"], r["p_size"], r["k"]] for r in rows]]).save())
    return read_records(docs, "docx.tables", {"p_partkey": "bigint", "p_size": "int", "name": "string"}, ["file"]).drop("file")


def _titled(w: docx.Writer, r: dict) -> None:
    w.heading(r["n_name"], 2).paragraph(f"key {r['k']}")


text_query("word_to_pdf", f"SELECT {_N}, string_agg(n_name || chr(10) || 'key ' || n_nationkey, chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation GROUP BY 1", NATIONS, "pdf", lambda rows: convert.docx_to_pdf(word(_titled)(rows)))
text_query("word_markdown", f"SELECT {_N}, string_agg(n_name || chr(10) || chr(10) || 'key ' || n_nationkey || chr(10) || chr(10), '' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1", NATIONS, "docx", word(_titled), extract_markdown)


@query(f"SELECT {_N}, n_nationkey, '<h2>' || n_name || '</h2>' AS heading FROM nation")
def word_html(spark, sf_dir):
    html = built(spark, sf_dir, *NATIONS, "html", lambda rows: docx.html(word(_titled)(rows)).encode())
    lines = html.select("file", F.posexplode(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x.startswith("<h2>"))).alias("n", "heading"))
    return lines.select("file", F.col("n").cast("bigint").alias("n_nationkey"), "heading")


@query(f"SELECT {_N}, n_name AS text, n_nationkey % 2 + 1 AS level FROM nation")
def word_from_markdown(spark, sf_dir):
    docs = built(spark, sf_dir, *NATIONS, "docx", lambda rows: docx.from_markdown(markdown.document(*[markdown.heading(r["k"] % 2 + 1, r["n_name"]) for r in rows])))
    return extract(docs, "docx.blocks", ["file"]).select("file", "text", F.col("level").cast("bigint").alias("level"))


# Slides ------------------------------------------------------------------------------------------------------


def deck(put: Callable[[pptx.Writer, int, dict], object]) -> Callable[[list[dict]], bytes]:
    """A deck with a slide for each of the rows."""

    def build(rows: list[dict]) -> bytes:
        w = pptx.Writer()
        for r in rows:
            put(w, w.slide(), r)
        return w.save()

    return build


def _slide(w: pptx.Writer, k: int, r: dict) -> None:
    w.shape(k, "ellipse", 1000 * r["i"], 2000, 3000, 4000, r["n_name"])
    w.text(k, f"key {r['k']}", y=900_000)
    w.slides[k]["notes"], w.slides[k]["transition"] = f"note {r['k']}", "fade"
    w.chart(k, "pie", ["a", "b"], {r["n_name"]: [1.0, float(r["k"])]})
    w.image(k, r["n_name"].encode())


part_query("deck_slides", f"SELECT {_N}, n_nationkey::INT AS slide, n_name || chr(10) || 'key ' || n_nationkey AS text, 'note ' || n_nationkey AS notes, 'fade' AS transition FROM nation", NATIONS, "pptx", "pptx.slides", ["slide", "text", "notes", "transition"], deck(_slide))
part_query("deck_shapes", f"SELECT {_N}, n_nationkey::INT AS slide, unnest(['shape', 'shape', 'chart', 'picture']) AS shape_type, unnest([0, 1, 2, 3]) AS z, unnest([1000 * n_nationkey, 457200, 457200, 457200])::BIGINT AS \"left\" FROM nation", NATIONS, "pptx", "pptx.shapes", ["slide", "shape_type", "z", "left"], deck(_slide))
part_query("deck_images", f"SELECT {_N}, 'ppt/media/image' || (n_nationkey + 1) || '_1.png' AS name FROM nation", NATIONS, "pptx", "pptx.images", ["name"], deck(_slide))


@query(f"SELECT {_N}, n_nationkey::VARCHAR AS place, 'pie' AS chart_type, n_name AS name, [1.0::DOUBLE, n_nationkey::DOUBLE] AS points FROM nation")
def deck_charts(spark, sf_dir):
    got = extract(built(spark, sf_dir, *NATIONS, "pptx", deck(_slide)), "pptx.charts", ["file"])
    return got.select("file", "place", "chart_type", F.inline("series")).select("file", "place", "chart_type", "name", F.col("values").alias("points"))


def _grouped(w: pptx.Writer, k: int, r: dict) -> None:
    w.text(k, r["n_name"])
    w.text(k, "second")
    w.group(k, 0, 1)


part_query("deck_groups", f"SELECT {_N}, n_nationkey::INT AS slide, unnest(['group', 'shape', 'shape']) AS shape_type, unnest([NULL, 900, 900])::INT AS parent, unnest(['', n_name, 'second']) AS text FROM nation", NATIONS, "pptx", "pptx.shapes", ["slide", "shape_type", "parent", "text"], deck(_grouped))


def _layouts(rows: list[dict]) -> bytes:
    w = pptx.Writer()
    w.slide()
    for r in rows:
        w.layout(r["n_name"])
    return w.save()


@query(f"SELECT {_N}, 'slideLayouts' AS kind, n_name AS name FROM nation UNION ALL SELECT 0, 'slideLayouts', 'Blank' UNION ALL SELECT 0, 'slideMasters', 'Master'")
def deck_layouts(spark, sf_dir):
    return extract(built(spark, sf_dir, *NATIONS, "pptx", _layouts), "pptx.parts", ["file"]).where("kind in ('slideLayouts', 'slideMasters')").select("file", "kind", "name")


part_query("deck_merged", f"SELECT {_N}, n_nationkey::INT AS slide, n_name AS text FROM nation", NATIONS, "pptx", "pptx.slides", ["slide", "text"], lambda rows: pptx.merged([deck(lambda w, k, r: w.text(k, r["n_name"]))([r]) for r in rows]))
part_query("deck_arranged", f"SELECT {_N}, (24 - n_nationkey)::INT AS slide, n_name AS text FROM nation", NATIONS, "pptx", "pptx.slides", ["slide", "text"], lambda rows: pptx.arranged(deck(lambda w, k, r: w.text(k, r["n_name"]))(rows), list(range(len(rows)))[::-1]))
part_query("deck_table_edits", f"SELECT {_N}, unnest([0, 1])::INT AS \"row\", unnest([['x', 'new', n_name], ['3', '', '4']]) AS cells FROM nation", NATIONS, "pptx", "pptx.tables", ["row", "cells"], deck(lambda w, k, r: w.table(k, pptx.table_column(pptx.table_without(pptx.table_row([["x", r["n_name"]], ["1", "2"]], ["3", "4"]), 1), 1, "new"))))
text_query("deck_to_pdf", f"SELECT {_N}, string_agg('key ' || n_nationkey || chr(10) || n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation GROUP BY 1", NATIONS, "pdf", lambda rows: convert.pptx_to_pdf(deck(lambda w, k, r: (w.text(k, r["n_name"], y=900_000), w.text(k, f"key {r['k']}", y=100)))(rows)))


# Pages -------------------------------------------------------------------------------------------------------


def pages(put: Callable[[pdf.Writer, dict], object]) -> Callable[[list[dict]], bytes]:
    """A PDF with a page for each of the rows."""

    def build(rows: list[dict]) -> bytes:
        w = pdf.Writer()
        w.info = {"title": f"file of {len(rows)}"}
        for r in rows:
            put(w.page().line_of(r["n_name"]), r)
        return w.save()

    return build


def _page(w: pdf.Writer, r: dict) -> None:
    w.bookmark(r["n_name"])
    w.link(10, 10, 20, 20, f"https://example.com/{r['k']}")
    w.field("Tx", f"f{r['k']}", 10, 40, 50, 10, "old")
    w.set_field(f"f{r['k']}", r["n_name"])
    w.attach(f"{r['n_name']}.txt", b"x")
    w.opacity(0.5).image(JPEG, 10, 10, 5, 5)


part_query("pdf_page_texts", f"SELECT {_N}, n_nationkey::INT AS page, n_name AS text FROM nation", NATIONS, "pdf", "pdf.pages", ["page", "text"], pages(_page))
part_query("pdf_glyph_places", f"SELECT {_N}, n_nationkey::INT AS page, n_name AS text, 50.0::DOUBLE AS x, 12.0::DOUBLE AS font_size FROM nation", NATIONS, "pdf", "pdf.glyphs", ["page", "text", "x", "font_size"], pages(_page))
part_query("pdf_infos", f"SELECT {_N}, 'file of ' || count(*) AS title, '1.7' AS pdf_version, count(*)::INT AS page_count, ['Helvetica', 'Helvetica-Bold', 'STSong-Light'] AS fonts FROM nation GROUP BY 1", NATIONS, "pdf", "pdf.info", ["title", "pdf_version", "page_count", "fonts"], lambda rows: pages(_page)(rows))
part_query("pdf_bookmarks", f"SELECT {_N}, n_nationkey::INT AS ord, n_name AS title, 0 AS depth, n_nationkey::INT AS page FROM nation", NATIONS, "pdf", "pdf.bookmarks", ["ord", "title", "depth", "page"], pages(_page))
part_query("pdf_annotations", f"SELECT {_N}, n_nationkey::INT AS page, unnest(['Link', 'Widget']) AS subtype, unnest(['https://example.com/' || n_nationkey, NULL]) AS uri FROM nation", NATIONS, "pdf", "pdf.annotations", ["page", "subtype", "uri"], pages(_page))
part_query("pdf_fields", f"SELECT {_N}, 'f' || n_nationkey AS name, 'Tx' AS type, n_name AS value FROM nation", NATIONS, "pdf", "pdf.fields", ["name", "type", "value"], pages(_page))
part_query("pdf_attachments", f"SELECT {_N}, n_name || '.txt' AS name, 'x' AS data FROM nation", NATIONS, "pdf", "pdf.attachments", ["name", "cast(data as string) as data"], pages(_page))
part_query("pdf_merged", f"SELECT {_N}, n_nationkey::INT AS page, n_name AS text FROM nation", NATIONS, "pdf", "pdf.pages", ["page", "text"], lambda rows: pdf.merged([pages(lambda w, r: None)([r]) for r in rows]))
part_query("pdf_extracted", f"SELECT {_N}, (n_nationkey - 2)::INT AS page, n_name AS text FROM nation WHERE n_nationkey BETWEEN 2 AND 5", NATIONS, "pdf", "pdf.pages", ["page", "text"], lambda rows: pdf.extract_pages(pages(lambda w, r: None)(rows), 3, 6))
part_query("pdf_encrypted", f"SELECT {_N}, n_nationkey::INT AS page, n_name AS text FROM nation", NATIONS, "pdf", "pdf.pages", ["page", "text"], lambda rows: crypto.encrypt_pdf(pages(lambda w, r: None)(rows), "", "owner"))
part_query("pdf_overlaid", f"SELECT {_N}, n_nationkey::INT AS page, n_name || chr(10) || 'DRAFT' AS text FROM nation", NATIONS, "pdf", "pdf.pages", ["page", "text"], lambda rows: pdf.overlaid(pages(lambda w, r: None)(rows), "DRAFT"))


# Mail, calendars, text and streams -----------------------------------------------------------------------------


def _storage(rows: list[dict]) -> bytes:
    root = cfb.Storage("Root Entry")
    for r in rows:
        root.put(f"Folder/S{r['k']}", r["n_name"].encode())
    return cfb.build(root)


def _message(rows: list[dict]) -> bytes:
    root = cfb.Storage("Root Entry")
    wide = lambda tag, s: root.put(f"__substg1.0_{tag:04X}001F", s.encode("utf-16-le"))
    wide(0x0037, f"{len(rows)} nations")
    wide(0x1000, "\n".join(r["n_name"] for r in rows))
    wide(0x0E04, "a@example.com; b@example.com")
    root.put("__properties_version1.0", bytes(32))
    return cfb.build(root)


part_query("cfb_streams", f"SELECT {_N}, 'Folder/S' || n_nationkey AS stream_path, n_name AS data FROM nation", NATIONS, "cfb", "cfb.streams", ["stream_path", "cast(data as string) as data"], _storage)
part_query("msg_messages", f"SELECT {_N}, count(*) || ' nations' AS subject, {_LISTED} AS text_body, ['a@example.com', 'b@example.com'] AS \"to\" FROM nation GROUP BY 1", NATIONS, "msg", "msg.messages", ["subject", "text_body", "to"], _message)


@query(f"SELECT {_N}, n_name || '.txt' AS file_name, 'text/plain' AS content_type FROM nation")
def eml_attachments(spark, sf_dir):
    build = lambda rows: mail.build({"from": "a@example.com", "to": ["b@example.com"], "subject": "s", "text_body": "b", "attachments": [{"file_name": f"{r['n_name']}.txt", "content_type": "text/plain", "data": b"x"} for r in rows]})
    got = extract(built(spark, sf_dir, *NATIONS, "eml", build), "eml.messages", ["file"])
    return got.select("file", F.inline("attachments")).select("file", "file_name", "content_type")


text_query("rtf_markdown", f"SELECT {_N}, string_agg(n_name || chr(10) || chr(10), '' ORDER BY n_nationkey) AS text FROM nation GROUP BY 1", NATIONS, "rtf", lambda rows: rtf.build([{"kind": "paragraph", "text": r["n_name"]} for r in rows]), extract_markdown)
text_query("md_text", f"SELECT {_N}, {_LISTED} || chr(10) AS text FROM nation GROUP BY 1", NATIONS, "md", lambda rows: "".join(f"# {r['n_name']}\n\n" for r in rows).encode())


@query("SELECT p_partkey, 'SUM($A$1:C' || (5 + p_size) || ')*\"A1\"' AS formula, 'xl/media/' || p_size AS path FROM part")
def part_references(spark, sf_dir):
    moved = F.udf(lambda n: K.shift_formula('SUM($A$1:B5)*"A1"', n, 1), "string")  # a function of 50 sizes, not of rows
    path = F.udf(lambda n: K.combine_path("xl/drawings", f"../media/{n}"), "string")
    sizes = table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", moved("p_size").alias("formula"), path("p_size").alias("path"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").join(sizes, "p_size").drop("p_size")
