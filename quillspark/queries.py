"""Queries over the driver's tables for the document operators, each with SQL where SQL can express it.

Round trips write a table's rows as documents, one for each bounded range of keys, read the documents again, and
must give the table back; their SQL is the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import lookups, pivot, restructure, rules, templates
from .sinks import documents
from .sources import extract, read_records, read_table
from .sources.files import extract_markdown, extract_text

PER_FILE = 500  # rows of a document

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Functions ---------------------------------------------------------------------------------------------------

_STRIP = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
 '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g'))"""


@query(f"SELECT page_id, url, {_STRIP} AS text FROM pages")
def pages_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", C.strip_html("html").alias("text"))


@query("""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)', 1)), ''),
 nullif(trim(regexp_extract(html, '(?i)<h1[^>]*>([^<]*)', 1)), '')) AS title FROM pages""")
def pages_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.extract_title("html").alias("title"))


_NAMES = "['a.xlsx','b.XLS','c.docx','d.doc','e.pptx','f.ppt','g.pdf','h.rtf','i.ods','j.epub','k.vcf','l.eml','m.ics','n.md','o.xps','p.msg','q.csv','r','s.tar.gz']"


@query(f"""WITH n AS (SELECT s_suppkey, {_NAMES}[s_suppkey % 19 + 1] AS name FROM supplier),
 e AS (SELECT *, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS ext FROM n)
 SELECT s_suppkey, ext, ext IN ('xlsx','xls','docx','doc','pptx','ppt','pdf','rtf','ods','epub','vcf','eml','ics','md','xps') AS supported FROM e""")
def supported_extensions(spark, sf_dir):
    names = F.expr(f"array({_NAMES[1:-1]})")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", C.extension(F.element_at(names, (F.col("s_suppkey") % 19 + 1).cast("int"))).alias("ext"))
    return s.withColumn("supported", C.is_supported("ext"))


@query("SELECT string_agg(r_regionkey || ',' || r_name, chr(10) ORDER BY r_regionkey) AS csv FROM region")
def region_csv(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", C.csv_line("r_regionkey", "r_name").alias("line"))
    return spark.sql("SELECT listagg(line, '\n') WITHIN GROUP (ORDER BY r_regionkey) AS csv FROM {rows}", rows=rows)


@query("SELECT string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation")
def nation_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", C.md_line("n_nationkey", "n_name").alias("line"))
    return spark.sql("SELECT listagg(line, '\n') WITHIN GROUP (ORDER BY n_nationkey) AS markdown FROM {rows}", rows=rows)


@query("""SELECT event_id, CASE WHEN regexp_matches(props, '[,"\\r\\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE coalesce(props, '') END AS csv,
 replace(replace(replace(coalesce(props, ''), '|', '\\|'), chr(10), ' '), chr(13), '') AS md FROM events""")
def events_escaped(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.csv_escape("props").alias("csv"), C.md_escape("props").alias("md"))


@query("""WITH i AS (SELECT p_partkey, (p_partkey * 37) % 18278 AS i FROM part),
 n AS (SELECT p_partkey, i, CASE WHEN i < 26 THEN chr((65 + i)::INT)
   WHEN i < 702 THEN chr((65 + (i - 26) // 26)::INT) || chr((65 + (i - 26) % 26)::INT)
   ELSE chr((65 + (i - 702) // 676)::INT) || chr((65 + (i - 702) // 26 % 26)::INT) || chr((65 + (i - 702) % 26)::INT) END AS letters FROM i)
 SELECT p_partkey, letters, i::INT AS back_col, (p_partkey % 1000)::INT AS back_row FROM n""")
def part_cell_refs(spark, sf_dir):
    letters = C.column_name((F.col("p_partkey") * 37) % 18278)
    p = table(spark, sf_dir, "part").select("p_partkey", letters.alias("letters"))
    ref = C.cell_ref(F.concat("letters", (F.col("p_partkey") % 1000 + 1).cast("string")))
    return p.select("p_partkey", "letters", ref["col"].cast("int").alias("back_col"), ref["row"].cast("int").alias("back_row"))


@query("SELECT o_orderkey, round(epoch_us(o_orderdate) / 86400000000.0 + 25569, 6) AS serial, o_orderdate AS back FROM orders")
def orders_serial(spark, sf_dir):
    s = C.date_to_serial("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(s, 6).alias("serial"), C.serial_to_date(s).cast(dict(table(spark, sf_dir, "orders").dtypes)["o_orderdate"]).alias("back"))


@query("""SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS share, length(regexp_replace(l_extendedprice::VARCHAR, '[^0-9]', '', 'g')) > 11 AS as_text,
 ((l_orderkey % 100000) / 100.0)::DOUBLE AS rk, (l_quantity * 12700)::BIGINT AS emu FROM lineitem""")
def lineitem_kernels(spark, sf_dir):
    share = C.percent(F.concat((F.round(F.col("l_discount") * 100, 4)).cast("decimal(10,4)").cast("string"), F.lit("%")))
    rk = C.decode_rk(F.shiftleft(F.col("l_orderkey") % 100000, 2) + 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(share, 6).alias("share"), C.written_as_text("l_extendedprice", "decimal").alias("as_text"), rk.alias("rk"), C.pt_to_emu("l_quantity").alias("emu"))


@query("""SELECT p_partkey, upper(substr(md5(p_name), 1, 6)) AS rgb, '80' || substr(md5(p_name), 1, 6) AS kept FROM part""")
def part_colors(spark, sf_dir):
    h = F.substring(F.md5(F.col("p_name").cast("binary")), 1, 6)
    return table(spark, sf_dir, "part").select("p_partkey", F.upper(C.rgb(F.concat(F.lit("FF"), h))).alias("rgb"), C.rgb(F.concat(F.lit("80"), h)).alias("kept"))


# Pivots and rules --------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS f_sum, count(l_quantity) FILTER (l_linestatus = 'F') AS f_count,
 round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS o_sum, nullif(count(l_quantity) FILTER (l_linestatus = 'O'), 0) AS o_count FROM lineitem GROUP BY 1""")
def lineitem_pivot(spark, sf_dir):
    p = pivot.pivot(table(spark, sf_dir, "lineitem"), ["L_RETURNFLAG"], [("l_quantity", "Sum", "sum"), ("l_quantity", "Count", "count")], "l_linestatus", ["F", "O"])
    return p.select("l_returnflag", F.round("F_sum", 2).alias("f_sum"), F.col("F_count").alias("f_count"), F.round("O_sum", 2).alias("o_sum"), F.col("O_count").alias("o_count"))


@query("""SELECT p_brand, round(sum(p_retailprice), 2) AS total, count(p_retailprice) AS n, round(avg(p_retailprice), 4) AS mean, max(p_retailprice) AS high, min(p_retailprice) AS low FROM part GROUP BY 1""")
def part_summaries(spark, sf_dir):
    fs = [("p_retailprice", f, a) for f, a in (("Sum", "total"), ("Count", "n"), ("Average", "mean"), ("Max", "high"), ("Min", "low"))]
    return pivot.pivot(table(spark, sf_dir, "part"), ["p_brand"], fs).withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("""SELECT c_mktsegment, round(sum(c_acctbal) FILTER (r_name = 'ASIA'), 2) AS asia, round(sum(c_acctbal) FILTER (r_name = 'EUROPE'), 2) AS europe
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1""")
def customer_pivot_filtered(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    p = pivot.pivot(rows, ["c_mktsegment"], [("c_acctbal", "Sum", "x")], "r_name", ["ASIA", "EUROPE"], {"r_name": ["ASIA", "EUROPE"]})
    return p.select("c_mktsegment", F.round("ASIA_x", 2).alias("asia"), F.round("EUROPE_x", 2).alias("europe"))


@query("SELECT DISTINCT p_type AS item FROM part WHERE p_type IS NOT NULL")
def part_shared_items(spark, sf_dir):
    return pivot.shared_items(table(spark, sf_dir, "part"), "P_TYPE")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, grouping_id(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def lineitem_subtotals(spark, sf_dir):
    p = pivot.pivot(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [("l_quantity", "Sum", "total")], subtotals=True)
    return p.withColumn("total", F.round("total", 2))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT o_totalprice BETWEEN 1000 AND 200000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END,
 CASE WHEN NOT o_orderdate >= TIMESTAMP '1995-01-01' THEN 'date' END, CASE WHEN NOT length(o_orderpriority) <= 8 THEN 'length' END, CASE WHEN o_totalprice <> floor(o_totalprice) THEN 'whole' END,
 CASE WHEN o_orderkey BETWEEN 10 AND 20 THEN 'key' END, CASE WHEN o_custkey = 7 THEN 'cust' END], lambda x: x IS NOT NULL), ',') AS broken FROM orders""")
def orders_validation(spark, sf_dir):
    checks = {
        "price": rules.in_range("o_totalprice", "decimal", "between", 1000, 200000),
        "status": rules.in_list("o_orderstatus", ["O", "F"]),
        "date": rules.in_range("o_orderdate", "date", "greaterThanOrEqual", "1995-01-01"),
        "length": rules.in_range("o_orderpriority", "textLength", "lessThanOrEqual", 8),
        "whole": rules.in_range("o_totalprice", "whole", "greaterThan", -1e18),
        "key": rules.in_range("o_orderkey", "whole", "notBetween", 10, 20),
        "cust": rules.in_range("o_custkey", "whole", "notEqual", 7),
    }
    return rules.validate(table(spark, sf_dir, "orders"), checks).select("o_orderkey", F.array_join("violations", ",").alias("broken"))


@query("""WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), s AS (SELECT p_partkey, p_retailprice AS v, p_size, CASE WHEN hi > lo THEN (p_retailprice - lo) / (hi - lo) ELSE 0 END AS s FROM part, b)
 SELECT p_partkey, v > 1500 AS high, v BETWEEN 1000 AND 1200 AS mid, CASE WHEN s * 100 >= 67 THEN 2 WHEN s * 100 >= 33 THEN 1 ELSE 0 END AS icon, round_even(s * 100, 0)::INT AS bar, p_size % 2 = 0 AND v > 1200 AS formula FROM s""")
def part_conditional_formats(spark, sf_dir):
    p = rules.with_bounds(table(spark, sf_dir, "part"), "p_retailprice")
    s = rules.share("p_retailprice")
    return p.select("p_partkey", rules.highlighted("p_retailprice", "greaterThan", 1500).alias("high"), rules.highlighted("p_retailprice", "between", 1000, 1200).alias("mid"), rules.icon(s, 3).alias("icon"), rules.data_bar(s).alias("bar"), rules.expression("p_size % 2 = 0 AND p_retailprice > 1200").alias("formula"))


@query("""SELECT p_brand, p_partkey, CASE WHEN max(p_retailprice) OVER w > min(p_retailprice) OVER w THEN round((p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w), 6) ELSE 0 END AS share
 FROM part WINDOW w AS (PARTITION BY p_brand)""")
def part_share_by_brand(spark, sf_dir):
    p = rules.with_bounds(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])
    return p.select("p_brand", "p_partkey", F.round(rules.share("p_retailprice"), 6).alias("share"))


# Templates ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, 'Dear ' || c_name || ' ({{Nothing}}), segment ' || c_mktsegment || '.' AS letter FROM customer")
def customer_mailmerge(spark, sf_dir):
    letter = templates.fill("Dear {{Name}} ({{Nothing}}), segment {{Segment}}.", {"Name": "c_name", "Segment": "c_mktsegment"})
    return table(spark, sf_dir, "customer").select("c_custkey", letter.alias("letter"))


@query("SELECT l_orderkey, string_agg(l_linenumber || ': part ' || l_partkey || ' ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS text FROM lineitem GROUP BY 1")
def order_invoice_lines(spark, sf_dir):
    return templates.repeated_rows(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_returnflag"], "{{No}}: part {{Part}} {{Flag}}", {"No": "l_linenumber", "Part": "l_partkey", "Flag": "l_returnflag"})


@query("""WITH f AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE replace(n_name, 'A', 'A ') END AS field FROM nation)
 SELECT n_nationkey, field, n_nationkey AS value FROM f""")
def merge_field_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 3
    fields = n.select("n_nationkey", F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).otherwise(F.replace("n_name", F.lit("A"), F.lit("A "))).alias("field"))
    return templates.fuzzy_lookup(fields, n.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value")))


@query("SELECT s_suppkey, 'Supplier ' || s_name || ' of ' || s_nationkey || chr(10) AS text FROM supplier")
def supplier_rtf_template(spark, sf_dir):
    from .formats import rtf

    template = rtf.build([{"kind": "paragraph", "text": "Supplier {{s_name}} of {{s_nationkey}}"}])
    filled = templates.fill_documents(table(spark, sf_dir, "supplier"), "rtf", template, ["s_name", "s_nationkey"])
    return filled.select("s_suppkey", extract_text("content", F.lit("rtf")).alias("text"))


@query("SELECT s_suppkey, 'Dear ' || s_name || '!' AS text FROM supplier")
def supplier_word_merge(spark, sf_dir):
    from .formats import docx

    template = docx.Writer().merge_field("S Name", "Dear ", "!").save()
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "sname")
    return templates.merge_documents(s, template, ["sname"]).select("s_suppkey", extract_text("content", F.lit("docx")).alias("text"))


@query("SELECT s_suppkey, 'Name: ' || s_name || chr(10) AS text FROM supplier")
def supplier_sheet_template(spark, sf_dir):
    from .formats import xlsx

    template = xlsx.build([("S", [["Name: {{s_name}}"]])])
    return templates.fill_documents(table(spark, sf_dir, "supplier"), "xlsx", template, ["s_name"]).select("s_suppkey", extract_text("content", F.lit("xlsx")).alias("text"))


# Restructuring -----------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
 n AS (SELECT doc_id, l, greatest(len(l) // 3, 1) AS per, greatest(least(3, len(l)), 1) AS n FROM l), p AS (SELECT *, unnest(generate_series(1, n)) AS page FROM n)
 SELECT doc_id, page::INT AS page, coalesce(array_to_string(l[(page - 1) * per + 1 : CASE WHEN page = n THEN len(l) ELSE page * per END], chr(10)), '') AS page_text FROM p""")
def docs_split_pages(spark, sf_dir):
    return restructure.split_pages(table(spark, sf_dir, "documents"), "text", 3).select("doc_id", "page", "page_text")


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
 n AS (SELECT doc_id, l, greatest(len(l) // 5, 1) AS per, greatest(least(5, len(l)), 1) AS n FROM l), p AS (SELECT *, unnest(generate_series(1, n)) AS page FROM n)
 SELECT doc_id, page::INT AS page, length(coalesce(array_to_string(l[(page - 1) * per + 1 : CASE WHEN page = n THEN len(l) ELSE page * per END], chr(10)), ''))::INT AS chars FROM p WHERE page BETWEEN 2 AND 3""")
def docs_page_range(spark, sf_dir):
    pages = restructure.page_range(restructure.split_pages(table(spark, sf_dir, "documents"), "text", 5), 2, 3)
    return pages.select("doc_id", "page", F.length("page_text").alias("chars"))


@query("""WITH a AS (SELECT conv_id, 0 AS source, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 1, turn, text FROM conversations WHERE role <> 'user' OR role IS NULL)
 SELECT conv_id, source, turn, row_number() OVER (PARTITION BY conv_id ORDER BY source, turn, text)::INT AS ordinal FROM a""")
def conversations_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    return restructure.merge([c.where(user), c.where(~user)], ["turn", "text"], ["conv_id"]).select("conv_id", "source", "turn", "ordinal")


@query("""WITH m AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 3 WHEN l_linenumber BETWEEN 2 AND 3 THEN l_linenumber - 1 ELSE l_linenumber END AS place, l_partkey FROM lineitem),
 c AS (SELECT l_orderkey, CASE WHEN place > 2 THEN place + 1 ELSE place END AS place, l_partkey FROM m UNION ALL SELECT l_orderkey, 3, l_partkey FROM m WHERE place = 2)
 SELECT l_orderkey, (CASE WHEN place > 4 THEN place - 1 ELSE place END)::INT AS place, l_partkey FROM c WHERE place <> 4""")
def slides_move(spark, sf_dir):
    slides = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), "l_partkey")
    return restructure.removed(restructure.cloned(restructure.moved(slides, 1, 3, "place"), 2, "place"), 4, "place")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS z, l_partkey FROM lineitem), t AS (SELECT *, max(z) OVER (PARTITION BY l_orderkey) AS top, max(CASE WHEN z = 2 THEN z END) OVER (PARTITION BY l_orderkey) AS place FROM s)
 SELECT l_orderkey, l_partkey, (CASE WHEN place IS NULL THEN z WHEN z = 2 THEN top WHEN z > 2 THEN z - 1 ELSE z END)::INT AS z FROM t""")
def shapes_to_front(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("z"), "l_partkey")
    return restructure.z_order(s, F.col("z") == 2, "front", ["l_orderkey"])


for _to, _target, _between in (
    ("back", "low", "WHEN z < 2 THEN z + 1"), ("forward", "least(3, top)", "WHEN z > 2 AND z <= least(3, top) THEN z - 1"), ("backward", "greatest(1, low)", "WHEN z < 2 AND z >= greatest(1, low) THEN z + 1"),
):

    def _moved(spark, sf_dir, to=_to):
        s = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("z"), "l_partkey")
        return restructure.z_order(s, F.col("z") == 2, to, ["l_orderkey"])

    _moved.__name__ = f"shapes_{_to}"
    query(f"""WITH s AS (SELECT l_orderkey, l_linenumber AS z, l_partkey FROM lineitem), t AS (SELECT *, max(z) OVER w AS top, min(z) OVER w AS low, max(CASE WHEN z = 2 THEN z END) OVER w AS place FROM s WINDOW w AS (PARTITION BY l_orderkey))
 SELECT l_orderkey, l_partkey, (CASE WHEN place IS NULL THEN z WHEN z = 2 THEN {_target} {_between} ELSE z END)::INT AS z FROM t""")(_moved)


@query("""WITH f AS (SELECT user_id, event_id, value > 50 AS m, lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
 i AS (SELECT user_id, event_id, m, sum(CASE WHEN coalesce(m, false) AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f)
 SELECT user_id, event_id, island::BIGINT AS island FROM i WHERE m""")
def table_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return restructure.islands(e, F.col("value") > 50, ["user_id"], "event_id").select("user_id", "event_id", "island")


@query("""WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n FROM lineitem),
 r AS (SELECT l_orderkey, l_linenumber, l_quantity, n, 1 AS page, l_quantity::DOUBLE AS y FROM l WHERE n = 1 UNION ALL
  SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.n, CASE WHEN r.y > 0 AND r.y + l.l_quantity > 60 THEN r.page + 1 ELSE r.page END,
   CASE WHEN r.y > 0 AND r.y + l.l_quantity > 60 THEN l.l_quantity ELSE r.y + l.l_quantity END::DOUBLE FROM r JOIN l ON l.l_orderkey = r.l_orderkey AND l.n = r.n + 1)
 SELECT l_orderkey, l_linenumber, l_quantity, page::INT AS page, y FROM r""")
def order_pages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return restructure.paginated(lines, F.col("l_quantity"), 60.0, ["l_orderkey"], "l_linenumber")


@query("""SELECT p_partkey // 40 AS page, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey)::INT AS "row", [p_partkey::VARCHAR, p_size::VARCHAR] AS cells FROM part""")
def glyph_rows(spark, sf_dir):
    page = F.floor(F.col("p_partkey") / 40)
    line = table(spark, sf_dir, "part").select(page.alias("page"), (800 - 20 * (F.col("p_partkey") % 40)).cast("double").alias("y"), "p_partkey", "p_size")
    digits = lambda c, x: F.transform(F.filter(F.split(F.col(c).cast("string"), ""), lambda s: s != ""), lambda s, i: F.struct((F.lit(x) + i * 8).cast("double").alias("x"), s.alias("text")))
    glyphs = line.select("page", "y", F.inline(F.concat(digits("p_partkey", 50), digits("p_size", 400))))
    return restructure.text_rows(glyphs, ["page"])


# Lookups -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def labels_lookup(spark, sf_dir):
    return lookups.looked_up(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT s_suppkey, coalesce(n_name, '#' || 'place' || s_suppkey) AS url FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2""")
def link_targets(spark, sf_dir):
    cells = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("r_id"), F.concat(F.lit("place"), "s_suppkey").alias("location"))
    relations = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("url"))
    return lookups.links(cells, relations).select("s_suppkey", "url")


@query("SELECT l_orderkey AS book, l_linenumber AS pos, l_partkey AS idref, p_name AS href FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 25")
def spine_order(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("idref"))
    manifest = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("idref"), F.col("p_name").alias("href"))
    # each book's manifest lists what it uses
    own = items.select("book", "idref").distinct().join(manifest, "idref").withColumnRenamed("idref", "id")
    return lookups.spine(items, own).select("book", "pos", "idref", "href")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unhandled_parts(spark, sf_dir):
    return lookups.unhandled(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT a.l_orderkey AS k, a.l_linenumber AS a_line, b.l_linenumber AS b_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_quantity - b.l_quantity) <= 5""")
def near_positions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    a = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("a_line"), F.col("l_quantity").alias("p"))
    b = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("b_line"), F.col("l_quantity").alias("q"))
    return lookups.near(a, b, ["k"], "p", "q", 5).select("k", "a_line", "b_line")


@query("""SELECT value, (row_number() OVER (ORDER BY first) - 1)::INT AS "index" FROM (SELECT p_brand AS value, min(p_partkey) AS first FROM part WHERE p_brand IS NOT NULL GROUP BY 1)""")
def brand_dictionary(spark, sf_dir):
    return lookups.dictionary(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("value", "index")


@query("SELECT n_nationkey, unnest(generate_series(0, n_nationkey - 1))::INT AS repeat FROM nation WHERE n_nationkey > 0")
def repeated_cells(spark, sf_dir):
    return lookups.expanded(table(spark, sf_dir, "nation").select("n_nationkey"), F.col("n_nationkey"))


@query("SELECT arg_min(p_partkey, p_partkey) AS p_partkey, p_brand FROM part GROUP BY p_brand")
def first_fonts(spark, sf_dir):
    return lookups.first_of(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("""SELECT c_custkey::INT AS id, coalesce(try_cast(c_name AS INT), 0) AS bad, c_acctbal AS balance, 0 AS missing FROM customer""")
def mapped_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select([F.col(x).cast("string").alias(x) for x in ("c_custkey", "c_name", "c_acctbal")])
    at = lambda n, d=None: C.field(c.columns, n, d)
    return lookups.mapped(c, {"id": (at("C_CUSTKEY"), "int"), "bad": (at("x", "c_name"), "int"), "balance": (at("c_acctbal"), "double"), "missing": (at("nowhere"), "int")})


# Documents ---------------------------------------------------------------------------------------------------


def _numbered(spark, sf_dir, name: str, key: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.floor(F.col(key) / PER_FILE).alias("file"), key, *columns)


def _cells(df: DataFrame, part: str, types: dict[str, str]) -> DataFrame:
    """Rows of a document's only table below its header, with typed columns."""
    rows = extract(df, part, ["file"]).where("`row` > 0")
    return rows.select(*[F.col("cells")[i].try_cast(t).alias(n) for i, (n, t) in enumerate(types.items())])


_PARTS_SQL = "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"
_PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_size": "int", "p_retailprice": "double"}


def _round_trip(fmt: str, part: str):
    def run(spark, sf_dir):
        docs = documents(_numbered(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_retailprice"), "file", fmt, list(_PART_TYPES))
        return _cells(docs, part, _PART_TYPES)

    run.__name__ = f"{fmt}_round_trip"
    return run


for _fmt, _part in (("xls", "xls.rows"), ("ods", "ods.rows"), ("docx", "docx.tables"), ("pptx", "pptx.tables"), ("rtf", "rtf.tables"), ("md", "md.tables")):
    query(_PARTS_SQL)(_round_trip(_fmt, _part))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def xlsx_round_trip(spark, sf_dir):
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    docs = documents(_numbered(spark, sf_dir, "orders", *columns), "file", "xlsx", columns)
    kind = dict(table(spark, sf_dir, "orders").dtypes)["o_orderdate"]
    types = {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}
    return read_records(docs, "xlsx.rows", types, ["file"]).select(*[F.col(c).cast(kind) if c == "o_orderdate" else c for c in columns])


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def supplier_inferred(spark, sf_dir):
    docs = documents(_numbered(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal"), "file", "xlsx", ["s_suppkey", "s_name", "s_acctbal"])
    return read_table(extract(docs.withColumn("path", F.col("name")), "xlsx.cells")).select("s_suppkey", "s_name", F.col("s_acctbal").cast("double"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def pdf_round_trip(spark, sf_dir):
    docs = documents(_numbered(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"), "file", "pdf", ["s_suppkey", "s_name", "s_nationkey"])
    rows = extract(docs, "pdf.tables", ["file"]).select(F.col("cells")[0].try_cast("bigint").alias("s_suppkey"), F.col("cells")[1].alias("s_name"), F.col("cells")[2].try_cast("int").alias("s_nationkey"))
    return rows.where("s_suppkey is not null")


@query("SELECT c_custkey, c_name, c_mktsegment, c_nationkey::VARCHAR AS country FROM customer")
def vcf_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    address = F.struct(F.lit(None).cast("string").alias("street"), F.col("c_nationkey").cast("string").alias("country"), F.lit("WORK").alias("type"))
    people = c.select(F.floor(F.col("c_custkey") / PER_FILE).alias("file"), F.col("c_custkey").cast("string").alias("uid"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("organization"), F.array(address).alias("addresses"))
    got = extract(documents(people, "file", "vcf"), "vcf.contacts", ["file"])
    return got.select(F.col("uid").try_cast("bigint").alias("c_custkey"), F.col("full_name").alias("c_name"), F.col("organization").alias("c_mktsegment"), F.col("addresses")[0]["country"].alias("country"))


@query("SELECT event_id, event_type, props, date_trunc('second', ts) AS ts FROM events")
def ics_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.floor(F.col("event_id") / PER_FILE).alias("file"), F.col("event_id").cast("string").alias("uid"), F.col("event_type").alias("summary"), F.col("props").alias("description"), F.col("ts").cast("timestamp").alias("start"))
    got = extract(documents(rows, "file", "ics"), "ics.events", ["file"])
    return got.select(F.col("uid").try_cast("bigint").alias("event_id"), F.col("summary").alias("event_type"), F.col("description").alias("props"), F.col("start").cast(dict(e.dtypes)["ts"]).alias("ts"))


@query("SELECT conv_id, turn, role, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM conversations WHERE text IS NOT NULL AND text <> ''")
def eml_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null and text <> ''")
    key = F.concat_ws("-", "conv_id", "turn", F.coalesce("role", F.lit("")), F.xxhash64("text"))
    rows = c.select(key.alias("file"), F.concat("role", F.lit("@example.com")).alias("from"), F.concat_ws(" ", "conv_id", "turn").alias("subject"), F.col("text").alias("text_body"))
    got = extract(documents(rows, "file", "eml"), "eml.messages", ["file"])
    words = F.split("subject", " ")
    body = F.replace(F.replace("text_body", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return got.select(words[0].try_cast("bigint").alias("conv_id"), words[1].try_cast("bigint").alias("turn"), F.split("from", "@")[0].alias("role"), body.alias("text"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''")
def epub_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null and text <> ''")
    body = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = d.select(F.floor(F.col("doc_id") / 50).alias("file"), F.concat(F.lit("<html><h1>"), F.col("doc_id").cast("string"), F.lit("</h1><p>"), body, F.lit("</p></html>")).alias("content"), F.lit("x").alias("title"))
    got = extract(documents(rows, "file", "epub", ["title", "content"]), "epub.chapters", ["file"])
    inner = F.regexp_extract("content", r"(?s)<p>(.*)</p>", 1)
    plain = F.replace(F.replace(F.replace(inner, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    return got.select(F.col("title").try_cast("bigint").alias("doc_id"), plain.alias("text"))


@query("SELECT r_regionkey, r_name || chr(10) AS text FROM region")
def xps_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("file"), F.col("r_name").alias("text"))
    return extract(documents(rows, "file", "xps"), "xps.pages", ["file"]).select(F.col("file").alias("r_regionkey"), "text")


@query()
def markdown_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return extract(docs, "md.nodes", ["doc_id"]).select("doc_id", "node_id", "parent_id", "depth", "ord", "kind", "text", "level")


@query("SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || r_regionkey || ' | ' || r_name || ' |' || chr(10) AS markdown FROM region")
def region_sheets_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("file"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    docs = documents(rows, "file", "xlsx", ["key", "name"])
    return docs.select(F.col("file").alias("r_regionkey"), extract_markdown("content", F.lit(".XLSX")).alias("markdown"))


@query("SELECT r_regionkey, 'key,name' || chr(10) || r_regionkey || ',' || r_name || chr(10) AS text FROM region")
def region_converted(spark, sf_dir):
    from .plans.extraction import converted

    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("file"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    xls = converted(converted(documents(rows, "file", "xlsx", ["key", "name"]), "xlsx", "ods"), "ods", "xls")
    return xls.select(F.col("file").alias("r_regionkey"), extract_text("content", F.lit("xls")).alias("text"))


from . import document_queries  # noqa: E402,F401  registers its queries here
