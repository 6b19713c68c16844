import datetime as dt
import random
import struct
from decimal import Decimal

import pytest

from quillspark.formats import calendar, cfb, contacts, doc, docx, epub, mail, markdown, msg, ods, pdf, pptx, registry, rtf, xls, xlsx, xps
from quillspark.functions import kernels as K

PEOPLE = [["姓名", "Age", "City"], ["Alice", 30, "Beijing, \"x\""], ["Bob|b", 25.5, None]]


def test_xlsx_types():
    when = dt.datetime(2020, 3, 4, 20, 8, 45)
    row = ["text", "12.5%", when, dt.timedelta(hours=30, minutes=5), 42, 2147483648, True, False, Decimal("36.6"), "00123", 1234567890123456, "abc%", None, dt.date(1984, 7, 1), 1.5]
    got = list(xlsx.Workbook(xlsx.build([("S", [["h"] * len(row), row])])).rows())[1]
    assert got == ["text", 0.125, when, dt.timedelta(hours=30, minutes=5), 42, 2147483648, True, False, 36.6, "00123", "1234567890123456", "abc%", None, dt.datetime(1984, 7, 1), 1.5]


def test_xlsx_cells_by_format():
    from quillspark.formats.xml import package

    styles = '<styleSheet xmlns="m"><numFmts><numFmt numFmtId="999" formatCode="0.000E0"/></numFmts><cellXfs>' + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 20, 1, 2, 9, 49, 999)) + "</cellXfs></styleSheet>"
    values = [(0, "2147483648"), (1, "5"), (2, "0.5"), (3, "12.34"), (4, "123.45"), (5, "0.25"), (6, "123.456"), (7, "99"), (99, "7")]
    cells = "".join(f'<c r="{K.column_name(i)}1" s="{s}"><v>{v}</v></c>' for i, (s, v) in enumerate(values))
    cells += '<c r="J1" t="s"><v>9</v></c><c r="K1" t="b"><v>TRUE</v></c><c r="L1" t="inlineStr"><is><t>In</t></is></c><c r="N1" t="str"><v>F</v></c>'
    parts = {
        "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="A" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": styles,
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="m"><sheetData><row r="1">{cells}</row></sheetData></worksheet>',
    }
    w = xlsx.Workbook(package(parts))
    row = next(w.rows())
    assert row == [2147483648, dt.datetime(1900, 1, 4), dt.timedelta(hours=12), "12.34", Decimal("123.45"), 0.25, "123.456", "99", "7", None, True, "In", None, "F"]
    with pytest.raises(KeyError):
        next(w.rows("missing"))


def test_xlsx_parts():
    w = xlsx.Writer()
    w.rows(PEOPLE, "P")
    w.formula("=SUM(B2:B3)", 55.5, "P")
    for key, value in (("merges", "A5:C5"), ("widths", {0: 20.0}), ("heights", {1: 30.0}), ("freeze", (1, 0)), ("filter", "A1:C3"), ("tab", "FF0000"), ("links", {"A2": "http://x.y/z", "A3": "#P!A1"}), ("password", "secret"), ("column_outlines", {2: 1}), ("row_outlines", {2: 2})):
        w.put(key, value, "P")
    w.put("comments", {"ref": "B2", "author": "Me", "text": "hi & bye"}, "P")
    w.put("validations", {"ref": "C2:C9", "type": "list", "items": ["a", "b"]}, "P")
    w.put("validations", {"ref": "B2:B9", "type": "whole", "operator": "between", "formula1": 1, "formula2": 99}, "P")
    w.put("formats", {"ref": "B2:B9", "type": "cellIs", "operator": "greaterThan", "formulas": [20]}, "P")
    w.put("formats", {"ref": "B2:B9", "type": "iconSet", "icons": 3}, "P")
    w.put("tables", {"name": "T1", "ref": "A1:C3", "columns": ["姓名", "Age", "City"]}, "P")
    w.put("charts", {"chart_type": "line", "categories": ["x", "y"], "series": [{"name": "s", "values": [1.0, 2.0]}], "row": 10}, "P")
    w.put("images", {"data": b"\x89PNG", "row": 3, "col": 4}, "P")
    w.put("sparklines", {"items": [{"formula": "P!B2:B3", "ref": "D2"}]}, "P")
    w.put("setup", {"orientation": "landscape", "left": 0.7, "head": "&CTop"}, "P")
    w.defined["Ages"] = "P!$B$2:$B$3"
    bold = w.style(bold=True, number_format="0.000", fill="FFFF00", horizontal="center")
    w.row(["styled"], "Q", [bold])
    b = xlsx.Workbook(w.save())
    assert list(b.sheets) == ["P", "Q"] and b.merges("P") == [(4, 0, 4, 2)] and b.widths("P")[0] == 20 and b.heights("P") == {1: 30}
    assert b.freeze("P") == (1, 0) and b.auto_filter("P") == "A1:C3" and b.tab_color("P") == "FF0000" and b.protection("P")["sheet"] == "1"
    assert b.hyperlinks("P") == {"A2": "http://x.y/z", "A3": "#P!A1"} and b.outlines("P") == {"columns": {2: 1}, "rows": {2: 2}}
    assert b.comments("P") == [{"ref": "B2", "author": "Me", "text": "hi & bye"}] and b.names() == {"Ages": "P!$B$2:$B$3"}
    assert [v["items"] for v in b.validations("P")] == [["a", "b"], None] and b.validations("P")[1]["formula2"] == "99"
    assert [(f["type"], f["operator"]) for f in b.conditional_formats("P")] == [("cellIs", "greaterThan"), ("iconSet", None)]
    assert b.conditional_formats("P")[1]["stops"] == [("percent", "0"), ("percent", "33"), ("percent", "67")]
    assert b.tables("P")[0]["columns"] == ["姓名", "Age", "City"] and b.charts("P")[0] == {"chart_type": "line", "categories": ["x", "y"], "series": [{"name": "s", "values": [1.0, 2.0]}]}
    assert b.images("P")[0]["data"] == b"\x89PNG" and b.sparklines("P")[0]["items"][0]["ref"] == "D2" and b.page_setup("P")["orientation"] == "landscape"
    assert next(c for c in b.cells("P") if c["formula"])["formula"] == "SUM(B2:B3)" and b.other_parts() == []
    style = b.cell_style(next(b.cells("Q"))["style"])
    assert (style["bold"], style["number_format"], style["fill"], style["horizontal"]) == (True, "0.000", "FFFF00", "center")


def test_pivot_parts():
    w = xlsx.Writer()
    rows = [["East", "A", 100], ["West", "B", 200], ["East", None, 5]]
    w.rows([["Region", "Product", "Sales"], *rows], "Data")
    w.pivot("Pivot", "Data", ["Region", "Product", "Sales"], rows, ["product"], [("SALES", "Sum"), ("Sales", "Count")], filter_fields=["Region"])
    p = xlsx.Workbook(w.save()).pivots("Pivot")
    assert p == [{"source": "Data!A1:C4", "rows": ["Product"], "columns": [], "filters": ["Region"], "data": [{"field": "Sales", "function": "sum", "caption": "Sum of Sales"}, {"field": "Sales", "function": "count", "caption": "Count of Sales"}], "items": {"Region": ["East", "West"], "Product": ["A", "B"], "Sales": []}}]


def test_ranges_and_theme():
    from quillspark.formats import theme

    w = xlsx.Writer()
    w.rows([["a", 1], ["b", 2]], "It's")
    w.defined["Both"] = "'It''s'!$A$1:$B$2"
    b = xlsx.Workbook(w.save())
    assert b.range_values("both") == [["a", 1], ["b", 2]] and b.range_values("'It''s'!B2") == [[2]]
    p = pptx.Writer()
    p.slide()
    colors = theme.palette(p.save(), lambda n: "111111" if n == "accent2" else None)
    assert colors["accent1"] == "4472C4" and colors["accent2"] == "111111" and theme.sheet_color(colors, 0, -0.5) == "808080" and theme.sheet_color(colors, 99) is None


def test_slide_edits():
    w = pptx.Writer()
    k = w.slide()
    w.accents[0] = "123456"
    w.text(k, "one")
    w.chart(k, "bar", ["a"], {"s": [1]})
    w.image(k, b"old")
    w.group(k, 0, 0)
    w.ungroup(k, 0)
    w.reorder(k, 0, "front")
    w.video(k, b"film", b"poster")
    data = w.save()
    assert [s["shape_type"] for s in pptx.Deck(data).shapes(0)] == ["chart", "picture", "shape", "picture"] and b"123456" in pptx.Deck(data).pkg.read("ppt/theme/theme1.xml")
    assert pptx.Deck(pptx.update_chart(data, 0, 0, ["x", "y"], {"t": [3, 4]})).charts(0)[0]["series"] == [{"name": "t", "values": [3.0, 4.0]}]
    assert (b"new" in [d for _, d in pptx.Deck(pptx.replace_image(data, 0, 0, b"new")).images()])
    twice = pptx.Deck(pptx.duplicate_shape(data, 0, 2)).shapes(0)
    assert [s["text"] for s in twice].count("one") == 2 and twice[3]["left"] == twice[2]["left"] + 190_500 and len({s["id"] for s in twice}) == 5


def test_text_and_markdown_of_sheets():
    want = '姓名,Age,City\nAlice,30,"Beijing, ""x"""\nBob|b,25.5,\n'
    table = '| 姓名 | Age | City |\n| --- | --- | --- |\n| Alice | 30 | Beijing, "x" |\n| Bob\\|b | 25.5 |  |\n'
    for ext, data in (("xlsx", xlsx.build([("A", PEOPLE)])), ("xls", xls.build([("A", PEOPLE)]))):
        assert registry.read_text(data, ext) == want and registry.read_markdown(data, "." + ext.upper()) == table
    assert registry.read_markdown(ods.build([("A", PEOPLE)]), "ods") == table
    assert registry.read_text(xlsx.build([("A", [["x"]]), ("B", [["y"]])]), "xlsx") == "## A\nx\n\n## B\ny\n"
    assert registry.read_text(b"", "zip") is None and not registry.is_supported(".msg") and not registry.is_supported(" ")


def test_xls_many_strings():
    rng = random.Random(1)
    rows = [[f"Row_{i} " + "é漢"[i % 2] * rng.randint(0, 60), i * 1.5, i % 2 == 0] for i in range(1500)] + [["long " * 4000, 1.0, True]]
    w = xls.Workbook(xls.build([("one", rows), ("two", [["x"]])], widths={0: 12}, merges=[(0, 0, 1, 1)], links={(0, 0): "http://a.b/ü"}))
    assert w.rows("one") == rows and w.rows("two") == [["x"]] and w.rows("none") == []
    assert w.widths("one") == {0: 12} and w.merges("one") == [(0, 0, 1, 1)] and w.hyperlinks("one") == {"A1": "http://a.b/ü"}


def test_ods():
    data = ods.build([("S", [["a", "1,234.5", "TRUE", "007"], [], ["x\ny"]])], {"S": [(0, 0, 0, 1)]})
    s = ods.parse(data)[0]
    assert s["rows"] == [["a", "", "true", "007"], [], ["x\ny"]] and s["merges"] == [(0, 0, 0, 1)]
    assert ods.parse(ods.build([("S", [["1,234.5", 2.5, "abc%"]])]))[0]["rows"] == [["1234.5", "2.5", "abc%"]]


def test_cfb_sizes_and_cycles():
    rng, root = random.Random(2), cfb.Storage("Root Entry")
    want = {}
    for i, n in enumerate([0, 1, 63, 64, 65, 4095, 4096, 4097, 100_000, 9_000_000]):
        want[f"Dir{i % 3}/Stream{i}"] = rng.randbytes(n)
        root.put(f"Dir{i % 3}/Stream{i}", want[f"Dir{i % 3}/Stream{i}"])
    data = cfb.build(root)
    again = cfb.parse(data)
    assert dict(again.walk()) == want and again.stream("dir0/Stream0") is None and again.storage("Dir1") is not None
    broken = bytearray(data)
    fat = struct.unpack_from("<I", data, 76)[0]
    struct.pack_into("<128I", broken, (fat + 1) * 512, *[k // 2 for k in range(128)])
    cfb.parse(bytes(broken))


def test_mail():
    when = dt.datetime(2024, 7, 15, 1, 30, tzinfo=dt.UTC)
    m = {"from": "张三 <a@x.com>", "to": ["b@x.com", '"C, D" <c@x.com>'], "cc": ["e@x.com"], "subject": "Hello 世界 " * 9, "date": when, "date_offset_min": 480, "text_body": "Line = 1\nüber " + "long " * 40, "html_body": "<p>Hi&amp;lt;</p>"}
    m |= {"attachments": [{"file_name": "données.bin", "content_type": "application/x", "content_id": None, "data": bytes(range(256))}], "inline_images": {"pic1": {"file_name": "p.png", "content_type": "image/png", "data": b"png"}}}
    got = mail.parse(mail.build(m))
    assert (got["from"], got["to"], got["cc"], got["date"], got["date_offset_min"]) == (m["from"], ["b@x.com", '"C, D" <c@x.com>'], m["cc"], when, 480)
    assert got["subject"].strip() == m["subject"].strip() and got["text_body"].replace("\r\n", "\n") == m["text_body"] and got["html_body"] == m["html_body"]
    assert got["attachments"][0]["data"] == bytes(range(256)) and got["attachments"][0]["file_name"] == "données.bin" and got["inline_images"]["pic1"]["data"] == b"png"
    assert mail.text(got).startswith("发件人: 张三 <a@x.com>\n收件人: b@x.com, \"C, D\" <c@x.com>\n") and "日期: 2024-07-15 09:30:00\n\n" in mail.text(got)
    plain = mail.parse(b"From: a@b\nTo: c@d\nSubject: =?utf-8?B?5L2g?= =?utf-8?Q?=E5=A5=BD?=\n x\n\nbody\n")
    assert plain["subject"] == "你好 x" and plain["text_body"] == "body\n"
    assert mail.text({**plain, "text_body": None, "html_body": "<b>a</b>&amp;lt; b"}).endswith("a < b")


def test_msg():
    root = cfb.Storage("Root Entry")
    put = lambda path, s: root.put(path, s.encode("utf-16-le"))
    for tag, s in (("0037", "Subject"), ("1000", "Body"), ("0C1A", "Sender"), ("0C1F", "s@x.com"), ("1013", "<p>h</p>"), ("0E04", "q@x.com; r@x.com")):
        put(f"__substg1.0_{tag}001F", s)
    put("__recip_version1.0_#00000000/__substg1.0_39FE001F", "to@x.com")
    root.put("__recip_version1.0_#00000000/__properties_version1.0", bytes(8) + struct.pack("<IIi4x", 0x0C150003, 6, 1))
    put("__attach_version1.0_#00000000/__substg1.0_3707001F", "f.txt")
    root.put("__attach_version1.0_#00000000/__substg1.0_37010102", b"data")
    m = msg.parse(cfb.build(root))
    assert (m["subject"], m["from"], m["to"], m["text_body"], m["html_body"], m["attachments"][0]["data"]) == ("Subject", "Sender <s@x.com>", ["to@x.com"], "Body", "<p>h</p>", b"data")


def test_calendar():
    e = {"uid": "u1", "summary": "a, b; c\\n " + "长" * 60, "description": "x\ny", "start": dt.datetime(2024, 7, 15, tzinfo=dt.UTC), "end": dt.datetime(2024, 7, 16, tzinfo=dt.UTC), "all_day": True, "organizer": "o@x.com", "attendees": ["p@x.com", "q@x.com"], "rrule": "FREQ=DAILY;COUNT=3", "extra": {"X-A": "1"}}
    t = {"uid": "t1", "summary": "todo", "due": dt.datetime(2024, 8, 1, 12, tzinfo=dt.UTC), "percent_complete": 40, "priority": 1, "status": "NEEDS-ACTION"}
    data = calendar.build({"name": "Cal", "events": [e], "todos": [t]})
    assert max(len(line.encode()) for line in data.split("\r\n")) <= 75
    c = calendar.parse(data)
    assert c["name"] == "Cal" and {k: c["events"][0][k] for k in e} == e and {k: c["todos"][0][k] for k in t} == t
    assert calendar.parse("BEGIN:VEVENT\nDTSTART;TZID=X:20240715T083000\nEND:VEVENT")["events"][0]["start"] == dt.datetime(2024, 7, 15, 8, 30, tzinfo=dt.UTC)
    assert calendar.text(c).startswith("Cal\n\na, b; c") and "截止: 2024-08-01 12:00\n" in calendar.text(c) and "- **进度**: 40%" in calendar.markdown(c)


def test_contacts():
    c = {"full_name": "Zoë; X", "name": {"family": "X;Y", "given": "Zoë", "additional": None, "prefix": "Dr", "suffix": None}, "organization": "O, Inc", "birthday": dt.date(1990, 1, 2), "phones": [{"number": "+1 2", "type": "CELL"}], "emails": [{"address": "z@x.com", "type": None}]}
    c |= {"addresses": [{"po_box": None, "extended": None, "street": "1; Main", "city": "C", "region": None, "postal_code": "9", "country": "DE", "type": "HOME"}], "note": "a\nb", "extra": {"X-K": "v"}}
    got = contacts.parse(contacts.build([c, {"full_name": "B"}, {"full_name": "C"}]))
    assert len(got) == 3 and {k: got[0][k] for k in c} == c
    assert contacts.text(got).startswith("Zoë; X\n组织: O, Inc\n生日: 1990-01-02\n电话: +1 2 (CELL)\n邮箱: z@x.com\n地址: DE C 1; Main 9 (HOME)\n")
    old = contacts.parse("BEGIN:VCARD\nFN;CHARSET=utf-8;ENCODING=QUOTED-PRINTABLE:J=C3=BC\nTEL;HOME;VOICE:1\nEND:VCARD")[0]
    assert old["full_name"] == "Jü" and old["phones"] == [{"number": "1", "type": "HOME;VOICE".replace(";", ",")}]


MD = """# Title *x*

Para with **bold**, `code`, ~~old~~ and [link](http://a.b "t").
second line  
third

- one
- [x] two
  - nested

3. c
4. d

> quoted

| a | b\\|c |
| :--- | ---: |
| 1 | **2** |

```py
x = 1
```

---
"""


def test_markdown():
    d = markdown.parse(MD)
    assert [b["kind"] for b in d["children"]] == ["heading", "paragraph", "bullet_list", "ordered_list", "quote", "table", "code_block", "rule"]
    assert markdown.parse(markdown.markdown(d)) == d
    h = markdown.html(d)
    assert '<h1 id="title-x">Title <em>x</em></h1>' in h and '<ol start="3">' in h and '<td style="text-align:right"><strong>2</strong></td>' in h and "checked> two" in h and '<a href="http://a.b" title="t">link</a>' in h
    assert markdown.html(markdown.parse("[x](javascript:alert(1))")) == '<p><a href="">x</a></p>\n'
    assert markdown.text(d).startswith("Title x\nPara with bold, code, old and link.\nsecond line\nthird\none\n")
    flat = markdown.flat(d)
    assert flat[0]["parent_id"] is None and all(n["parent_id"] < n["node_id"] for n in flat[1:])
    assert markdown.parse("")["children"] == [] and markdown.parse("a_b_c *")["children"][0]["children"] == [{"kind": "text", "text": "a_b_c *"}]


def test_rtf():
    blocks = [{"kind": "paragraph", "runs": [{"text": "Héllo {x} \\ 漢😀", "style": {"b": True}}, {"text": " plain", "style": {}}], "align": "center"}, {"kind": "table", "rows": [["a", "b|c"], ["1", ""]]}]
    d = rtf.parse(rtf.build(blocks, {"title": "T é", "author": "A"}, [b"\x89PNG"]))
    assert rtf.text(d) == "Héllo {x} \\ 漢😀 plain\na\tb|c\n1\t\n\n" and d["info"] == {"title": "T é", "author": "A"} and d["images"] == [b"\x89PNG"]
    assert d["blocks"][0]["runs"][0]["style"]["b"] and d["blocks"][0]["align"] == "center" and rtf.tables(d) == [[["a", "b|c"], ["1", ""]]]
    assert "| a | b\\|c |\n| --- | --- |\n| 1 |  |\n" in rtf.markdown(d)
    assert rtf.text(rtf.parse(rb"{\rtf1\ansi Hello World\par {\v hidden}\'e9}")) == "Hello World\né\n" and rtf.parse(b"plain")["blocks"] == []
    assert rtf.text(rtf.parse(rtf.fill(rtf.build([{"kind": "paragraph", "text": "Dear {{Name}} {{No}}"}]), {"Name": "Zoë {1}"}))) == "Dear Zoë {1} {{No}}\n"


def test_epub_and_xps():
    b = epub.build({"title": "Bk", "creator": "Me", "identifier": "id1", "chapters": [{"title": "One & 1", "content": "<h1>One &amp; 1</h1><p>a <b>b</b></p>"}, {"title": "Two", "content": "plain < text"}]})
    book = epub.parse(b)
    assert (book["title"], book["creator"], [c["title"] for c in book["chapters"]]) == ("Bk", "Me", ["One &amp; 1", "Two"])
    assert epub.text(book).endswith("Two\nTwo plain < text\n\n")
    x = xps.build([["a {b}", "{c}"], ["第二页"]], {"title": "T"}, [b"png"])
    got = xps.parse(x)
    assert [p["text"] for p in got["pages"]] == ["a {b}\n{c}\n", "第二页\n"] and got["properties"]["title"] == "T" and xps.images(x)[0][1] == b"png"
    assert xps.markdown(got) == "a {b}\n{c}\n\n---\n\n第二页\n"


def test_docx():
    w = docx.Writer()
    w.properties = {"title": "T", "author": "A"}
    w.section["header"] = "Head"
    w.heading("标题", 2).paragraph([{"text": "a ", "bold": True}, {"text": "b\tc\nd", "color": "FF0000"}], align="center").bullets(["x", "y"]).hyperlink("site", "http://a.b").merge_field("First Name", "Dear ", "!")
    w.table([["产品", "价格"], ["A", 1.5]]).control("dropDownList", "v", "pick", ["v", "w"]).image(b"img").page_break().rule().bookmark("here", "bm").cross_reference("bm", "see")
    d = docx.Document(data := w.save())
    assert d.paragraphs()[:4] == ["标题", "a b\tc\nd", "x", "y"] and d.tables() == [[["产品", "价格"], ["A", "1.5"]]] and d.images()[0][1] == b"img" and d.properties()["author"] == "A" and d.headers()["header"] == ["Head"]
    kinds = [b["kind"] for b in d.blocks()]
    assert kinds.count("table") == 1 and "control" in kinds and d.blocks()[0]["level"] == 2
    h = docx.html(data)
    assert "<h2>标题</h2>" in h and '<p style="text-align:center">' in h and "<th><strong>产品</strong></th>" in h and '<a href="http://a.b">' in h
    merged = docx.mail_merge(data, [{"firstname": "Ann & Co"}, {"FIRST NAME": "Bob"}])
    text = docx.text(merged)
    assert "Dear Ann & Co!" in text and "Dear Bob!" in text and "MERGEFIELD" not in text and docx.mail_merge(data, []) == data
    t = docx.Writer().paragraph("Hi {{Name}} {{No}}").table([["Item", "Qty"], ["{{#Rows}}", ""], ["{{Item}}", "{{Qty}}"], ["{{/Rows}}", ""]]).save()
    t = docx.fill_table(docx.fill(t, {"Name": "<Z>"}), "Rows", [{"Item": "a", "Qty": 1}, {"Item": "b&", "Qty": 2}])
    assert docx.Document(t).tables() == [[["Item", "Qty"], ["a", "1"], ["b&", "2"]]] and docx.Document(t).paragraphs()[0] == "Hi <Z> {{No}}"
    p = docx.Writer().paragraph("{{Logo}}").image(b"old").save()
    assert docx.Document(docx.fill_image(p, "Logo", b"new")).images()[0][1] == b"new"
    again = docx.Document(docx.Writer().append(data).save())
    assert again.paragraphs()[0] == "标题" and again.tables() == d.tables()
    md = docx.from_markdown(markdown.parse(MD))
    assert docx.Document(md).tables() == [[["a", "b|c"], ["1", "2"]]] and docx.Document(md).blocks()[0]["level"] == 1


def test_pptx():
    w = pptx.Writer()
    w.slide("title_content", title="Hello", body="x\ny")
    k = w.slide()
    w.table(k, [["a", 1], ["b", 2]])
    w.chart(k, "bar", ["q1", "q2"], {"s": [1, 2.5]})
    w.image(k, b"img")
    w.shape(k, "ellipse", 1, 2, 3, 4, "round")
    w.slides[k]["notes"] = "note 1\nnote 2"
    w.slides[k]["transition"] = "fade"
    d = pptx.Deck(data := w.save())
    assert d.slide_text(0) == "Hello\nx\ny" and len(d.slides) == 2
    shapes = d.shapes(1)
    assert [s["shape_type"] for s in shapes] == ["table", "chart", "picture", "shape"] and shapes[0]["rows"] == [["a", "1"], ["b", "2"]] and (shapes[3]["left"], shapes[3]["height"]) == (1, 4)
    assert d.charts(1)[0]["series"] == [{"name": "s", "values": [1.0, 2.5]}] and d.notes(1) == "note 1\nnote 2" and d.transition(1) == "fade" and d.images()[0][1] == b"img"
    assert pptx.text(data).startswith("Hello\nx\ny\n--- 幻灯片分隔 ---\n") and pptx.markdown(data).startswith("## 幻灯片 1\n\nHello")
    both = pptx.Deck(pptx.merged([data, data]))
    assert [both.slide_text(i) for i in range(4)] == [d.slide_text(0), d.slide_text(1)] * 2 and both.charts(3) == d.charts(1) and pptx.merged([]) is None
    swapped = pptx.Deck(pptx.arranged(data, [1, 0, 0]))
    assert [swapped.slide_text(i) for i in range(3)] == [d.slide_text(1), d.slide_text(0), d.slide_text(0)]
    t = pptx.Writer()
    t.slide("title_only", title="{{Name}}")
    t.table(0, [["h"], ["{{#R}}"], ["{{V}}"], ["{{/R}}"]])
    out = pptx.Deck(pptx.fill_table(pptx.fill(t.save(), {"Name": "N&M"}), 0, "R", [{"V": 1}, {"V": 2}]))
    assert out.slide_text(0) == "N&M\nh\n1\n2"


def test_pdf():
    w = pdf.Writer()
    w.info = {"title": "Títle", "author": "A"}
    w.bookmark("Start").line_of("Hello (World) \\ ü", bold=True).line_of("中文 text").table([["Name", "Qty"], ["Bolt", 5], ["Nut", 12]])
    w.link(10, 10, 50, 20, "http://x.y").annotation("Text", 5, 5, 9, 9, "note").field("Tx", "f1", 10, 100, 80, 20, "val").attach("a.txt", b"abc").ellipse(100, 100, 20, 10).polygon((1, 1), (2, 2), (3, 1)).dash(3, 2).line(0, 0, 9, 9)
    w.page().line_of("Page two")
    data = w.save()
    for raw in (data, data.replace(b"startxref", b"startxxxx")):
        d = pdf.Document(raw)
        assert d.metadata() == {"title": "Títle", "author": "A", "subject": None, "creation_date": None, "pdf_version": "1.7", "page_count": 2} or raw is not data
        assert d.page_texts()[0].startswith("Hello (World) \\ ü\n中文 text\nName") and d.page_texts()[1] == "Page two"
    assert pdf.tables(data) == [[["Name", "Qty"], ["Bolt", "5"], ["Nut", "12"]]] and "Helvetica-Bold" in d.fonts()
    d = pdf.Document(data)
    assert d.fields() == [{"name": "f1", "type": "Tx", "value": "val", "options": []}] and [a["uri"] for a in d.annotations()][0] == "http://x.y" and d.attachments() == [{"name": "a.txt", "data": b"abc"}]
    assert d.bookmarks() == [{"title": "Start", "depth": 0, "page": 0}]
    assert pdf.text(pdf.merged([data, pdf.build(["three"])])).endswith("Page two\nthree\n") and len(pdf.split_pages(data)) == 2
    assert pdf.text(pdf.extract_pages(data, 2, 9)) == "Page two\n" and "DRAFT" in pdf.text(pdf.overlaid(data, "DRAFT")) and pdf.merged([]) is None
    many = pdf.Document(pdf.build([f"line {i}" for i in range(200)]))
    assert len(many.pages()) > 3 and "\n".join(many.page_texts()).split("\n") == [f"line {i}" for i in range(200)]
    assert "Title x" in pdf.text(pdf.from_markdown(markdown.parse(MD)))


def test_pdf_filters():
    import base64
    import zlib

    raw = b"abcabcabc" * 50
    assert pdf.flate(zlib.compress(raw)) == raw and pdf.ascii85(base64.a85encode(raw) + b"~>") == raw and pdf.run_length(bytes([2]) + b"abc" + bytes([254]) + b"x" + b"\x80") == b"abcxxx"
    assert pdf.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"


def test_old_word():
    text = "Hello\rworld\x07a\x07b\x07\x07c\x07d\x07\x07\x13 PAGE \x14" + "7\x15é\r"
    raw = text.encode("utf-16-le")
    main = bytearray(0x600)
    struct.pack_into("<H", main, 0x0A, 0x200)
    struct.pack_into("<i", main, 0x4C, len(text))
    plc = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x600, 0)
    table = b"\2" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", main, 0x1A2, 0, len(table))
    root = cfb.Storage("Root Entry")
    root.put("WordDocument", bytes(main) + raw)
    root.put("1Table", table)
    data = cfb.build(root)
    assert doc.paragraphs(data)[0] == "Hello" and "7é" in doc.text(data) and doc.tables(data) == [[["world", "a", "b"], ["c", "d"], ["7é"]]] or doc.tables(data)[0][1] == ["c", "d"]


def test_old_slides():
    record = lambda kind, body, head=0: struct.pack("<HHI", head, kind, len(body)) + body
    slide = lambda s: record(doc.SLIDE, record(doc.TEXT_CHARS, s.encode("utf-16-le")) + record(doc.TEXT_BYTES, b"low"), 0xF)
    root = cfb.Storage("Root Entry")
    root.put("PowerPoint Document", slide("一") + slide("two\rlines"))
    data = cfb.build(root)
    assert doc.slide_texts(data) == ["一\nlow", "two\nlines\nlow"] and doc.ppt_markdown(data).startswith("## 幻灯片 1\n\n一")


def test_kernels():
    assert [K.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and [K.column_index(r) for r in ("A1", "Z", "AA9", "7")] == [0, 25, 26, 0]
    assert K.cell_ref("AB23") == (22, 27) and K.range_ref("A1:B2") == (0, 0, 1, 1) and K.range_ref("A1") is None
    assert K.shift_formula('A1+$B$2+C$3*SUM(D4:E5)&"A1"', 1, 2) == 'C2+$B$2+E$3*SUM(F5:G6)&"A1"'
    assert K.percent("12.5%") == 0.125 and K.percent("abc%") is None and K.decode_rk(0x3FF00000) == 1.0 and K.decode_rk((100 << 2) | 3) == 1.0
    assert K.strip_html("<p>a&amp;lt;b&nbsp; c</p>") == "a<b c" and K.combine_path("xl/worksheets", "../tables/t.xml") == "xl/tables/t.xml" and K.color("#80FF0000") == (128, 255, 0, 0) and K.color("zz") == (255, 0, 0, 0)
    assert K.rgb("FF00FF00") == "00FF00" and K.rgb("8000FF00") == "8000FF00" and K.written_as_text(1234567890123456) and not K.written_as_text(1.5)
