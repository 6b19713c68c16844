"""Column kernels give what the plain ones give."""

import datetime as dt

import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import kernels as K
from quillspark.operators import lookups, restructure, rules, templates


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make("v").alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_text_kernels(spark):
    texts = ["", None, "a,b", 'q"q', "x|y\nz\r", "<p>a&amp;lt; b</p>", "<TITLE> t </TITLE><h1>h</h1>", "12.5%", "abc%", "FF00FF00"]
    assert column(spark, texts, "string", C.csv_escape) == [K.csv_escape(t) for t in texts]
    assert column(spark, texts, "string", C.md_escape) == [K.md_escape(t) for t in texts]
    assert column(spark, texts, "string", C.strip_html) == [K.strip_html(t) for t in texts]
    assert column(spark, texts[2:], "string", C.extract_title) == [K.extract_title(t) for t in texts[2:]]
    assert column(spark, texts[2:], "string", C.percent) == [K.percent(t) for t in texts[2:]]
    assert column(spark, texts, "string", C.rgb) == [K.rgb(t) for t in texts]


def test_references(spark):
    values = [0, 25, 26, 701, 702, 18277, 18278, 16383]
    names = column(spark, values, "bigint", C.column_name)
    assert names == [K.column_name(v) for v in values] and column(spark, names, "string", C.column_index) == values


def test_numbers(spark):
    rks = [0x3FF00000, 0x3FF00001, (100 << 2) | 2, (100 << 2) | 3, 0xFFFFFFFE, 0xC0000000, 0]
    assert column(spark, rks, "bigint", C.decode_rk) == [K.decode_rk(r) for r in rks]
    when = dt.datetime(2020, 3, 4, 20, 8, 45)
    assert abs(column(spark, [when], "timestamp_ntz", C.date_to_serial)[0] - K.date_to_serial(when)) < 1e-9
    assert column(spark, [5.0], "double", C.serial_to_date)[0] == dt.datetime(1900, 1, 4)
    assert column(spark, [2.54], "double", C.cm_to_emu) == [K.cm_to_emu(2.54)]
    assert [C.field(["Id", "姓名", "Other"], *a) for a in (("id",), ("name", "姓名"), ("x", None, "Other"), ("y",))] == ["Id", "姓名", "Other", None]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(-5, 5))
def test_reference_round_trip(i, d):
    assert K.column_index(K.column_name(i)) == i
    moved = K.shift_formula(f"{K.column_name(i % 700 + 10)}{abs(d) + 10}", d, d)
    assert K.cell_ref(moved) == (abs(d) + 9 + d, i % 700 + 10 + d)


def test_rules(spark):
    values = ["5", "5.5", "x", None, "2024-01-01"]
    assert column(spark, values, "string", lambda v: rules.in_range(v, "whole", "between", 1, 9)) == [True, False, False, True, False]
    assert column(spark, values, "string", lambda v: rules.in_range(v, "textLength", "lessThan", 3)) == [True, False, True, True, False]
    assert column(spark, values, "string", lambda v: rules.in_list(v, ["x"])) == [False, False, True, True, False]


def test_template_does_not_fill_twice(spark):
    df = spark.createDataFrame([("{{B}}", "b"), (None, "x")], "a string, b string")
    assert [r.t for r in df.select(templates.fill("{{A}}-{{B}}{{C}}", {"A": "a", "B": "b"}).alias("t")).collect()] == ["{{B}}-b{{C}}", "-x{{C}}"]


def test_pagination(spark):
    df = spark.createDataFrame([(1, i, float(h)) for i, h in enumerate([30, 30, 50, 10, 200, 5])], "k int, o int, h double")
    got = restructure.paginated(df, F.col("h"), 60.0, ["k"], "o").orderBy("o").collect()
    assert [(r.page, r.y) for r in got] == [(1, 30), (1, 60), (2, 50), (2, 60), (3, 200), (4, 5)]


def test_flattened(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('City', 'C', 'Geo', named_struct('X', 2)) AS Address")
    assert lookups.flattened(df, 0).columns == ["id"] and lookups.flattened(df).columns == ["id", "Address.City"]
    assert lookups.flattened(df, 2).columns == ["id", "Address.City", "Address.Geo.X"]


def test_spine_and_dictionary(spark):
    items = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (2, 0, "a")], "book int, pos int, idref string")
    manifest = spark.createDataFrame([(1, "a", "a.html"), (2, "a", "b.html")], "book int, id string, href string")
    assert sorted((r.book, r.href) for r in lookups.spine(items, manifest).collect()) == [(1, "a.html"), (2, "b.html")]
