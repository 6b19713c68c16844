"""Files read and written through Spark: parts, typed tables, data sources, folders, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.formats import docx, mail, markdown, pdf, pptx, rtf, xlsx
from quillspark.plans import extraction
from quillspark.sinks import documents, write_files
from quillspark.sources import extract, files, read, read_markdown, read_records, read_table, read_text, register
from quillspark.sources.files import _mapped
from quillspark.sources.parts import PARTS
from quillspark.streaming import ingest


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    when = dt.datetime(2024, 1, 2, 3, 4, 5)
    grid = [["id", "name", None, "when", "share", "ok"], [1, "a", 2.5, when, "12.5%", True], [3, "b|c", None, when, None, False]]
    (d / "sub").mkdir()
    out = {
        "one.xlsx": xlsx.build([("S", grid)]), "sub/two.XLSX": xlsx.build([("S", grid)]), "note.md": b"# T\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n", "mail.eml": mail.build({"from": "a@b", "to": ["c@d"], "subject": "S", "text_body": "body", "date": when}),
        "doc.docx": docx.Writer().paragraph("hello").table([["x"], ["y"]]).save(), "deck.pptx": pptx.Writer().save(), "p.pdf": pdf.build(["line"]), "r.rtf": rtf.build([{"kind": "paragraph", "text": "rich"}]), "other.bin": b"\0", "bad.docx": b"not a zip",
    }
    for name, data in out.items():
        (d / name).write_bytes(data)
    return str(d)


def test_files_and_catalog(spark, folder):
    got = {(r.path.rpartition("/")[2], r.ext, r.supported) for r in extraction.catalog(spark, folder).collect()}
    assert ("two.XLSX", "xlsx", True) in got and ("other.bin", "bin", False) in got and len(got) == 10


def test_typed_table(spark, folder):
    cells = read(spark, folder + "/one.xlsx", "xlsx")
    t = read_table(cells).orderBy("id")
    assert dict(t.dtypes) | {"path": "", "sheet": "", "row": ""} == {"id": "bigint", "name": "string", "Column3": "double", "when": "timestamp", "share": "double", "ok": "boolean", "path": "", "sheet": "", "row": ""}
    first = t.first()
    assert (first.id, first.name, float(first.Column3), first.share, first.ok) == (1, "a", 2.5, 0.125, True)
    text = read_table(cells, mode="string").orderBy("id").first()
    assert (text.id, text.when, text.ok) == ("1", "2024-01-02 03:04:05", "true")
    assert read_table(cells, schema={"id": "double"}).dtypes[3] == ("id", "double")
    assert read_table(cells, mode="variant").select(F.schema_of_variant("id")).first()[0] == "BIGINT"
    assert read_table(cells, "missing").count() == 0


def test_records(spark):
    """By each file's own header, in any order and case; what lacks or can't be cast is null; keeps clashing names apart."""
    one = xlsx.build([("S", [["ID", "name", "extra"], [1, "a", 9], ["x", None, 9], [2]]), ("T", [["name"], ["other"]])])
    two = xlsx.build([("S", [["Name ", "id"], ["b", 3]])])
    df = spark.createDataFrame([("p", one), ("q", two), ("r", None), ("s", xlsx.build([("S", [])]))], "path string, content binary")
    got = read_records(df, "xlsx.rows", {"id": "bigint", "name": "string", "when": "timestamp"}, sheet="S")
    assert sorted(map(tuple, got.collect()), key=str) == [("p", 1, "a", None), ("p", 2, None, None), ("p", None, None, None), ("q", 3, "b", None)]
    assert {r.name for r in read_records(df, "xlsx.rows", {"name": "string"}).collect()} == {"a", None, "other", "b"}


def test_errors(spark, folder):
    bad = files(spark, folder, "*.docx")
    with pytest.raises(Exception, match="zip"):
        extract(bad, "docx.paragraphs").collect()
    assert [r.text for r in extract(bad, "docx.paragraphs", errors="skip").collect()] == ["hello", "x", "y"]
    rows = extract(bad, "docx.paragraphs", errors="null").collect()
    assert sorted((r.path.rpartition("/")[2], r.text or "") for r in rows) == [("bad.docx", ""), ("doc.docx", "hello"), ("doc.docx", "x"), ("doc.docx", "y")]


def test_broken_midway(spark):
    """Nothing of a file whose rows break off, but for its own row."""

    def rows(data):
        yield {"n": 1}
        if data == b"bad":
            raise ValueError("broken")

    df = spark.createDataFrame([("a", b"good"), ("b", b"bad")], "path string, content binary")
    got = {e: sorted((r.path, r.n) for r in _mapped(df, ["path"], "content", "n int", rows, e).collect()) for e in ("null", "skip")}
    assert got == {"null": [("a", 1), ("b", None)], "skip": [("a", 1)]}


def test_extensions_in_any_case(spark, folder):
    assert {r.path.rpartition("/")[2] for r in read(spark, folder, "xlsx").collect()} == {"one.xlsx", "two.XLSX"}
    assert {r.path.rpartition("/")[2] for r in extraction.tables(spark, folder + "/sub").collect()} == {"two.XLSX"}


def test_unified(spark, folder):
    good = "*.{md,eml,pdf,rtf,xlsx,bin}"
    rows = {r.path.rpartition("/")[2]: r.t for r in files(spark, folder, good).select("path", extraction.extract_text("content", "ext").alias("t")).collect()}
    assert rows["p.pdf"] == "line\n" and rows["r.rtf"] == "rich\n" and rows["other.bin"] is None and rows["one.xlsx"].startswith("id,name,,when")
    assert {r.path.rpartition(".")[2] for r in read_text(spark, folder + "/note.md").collect()} == {"md"}
    assert read_markdown(spark, folder + "/one.xlsx").first().markdown.startswith("| id | name |")


def test_every_part_has_a_schema(spark):
    for part in PARTS.values():
        spark.createDataFrame([], part.schema)


def test_data_source(spark, folder, tmp_path):
    register(spark)
    assert spark.read.format("xlsx").option("part", "rows").load(folder).count() == 3
    assert spark.read.format("eml").load(folder).select("subject").first().subject == "S"
    docs = documents(spark.range(10).select((F.col("id") % 2).alias("k"), "id"), "k", "xlsx", ["id"], order="id")
    write_files(docs, str(tmp_path), "xlsx")
    back = read(spark, str(tmp_path), "xlsx", "rows").where("`row` > 0")
    assert sorted(int(r.cells[0]) for r in back.collect()) == list(range(10))


def test_tables_and_conversion(spark, folder):
    got = extraction.converted(files(spark, folder, "*.md"), "md", "html").first().content.decode()
    assert "<h1" in got and "<td>1</td>" in got
    assert pdf.text(extraction.converted(files(spark, folder, "*.md"), "md", "pdf").first().content).startswith("T\n")
    nodes = extract(files(spark, folder, "*.md"), "md.nodes")
    assert nodes.where("kind = 'table_cell'").count() == 4 and markdown.parse("")["children"] == []


def test_stream(spark, folder, tmp_path):
    stream = ingest.texts(ingest.arriving(spark, folder, "*.{md,rtf,bin}"))
    ingest.write_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"T\na\tb\t\n1\t2\t\n", "rich\n"}
    q = ingest.counts(ingest.arriving(spark, folder)).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(files) FROM arrivals").first()[0] == 10
