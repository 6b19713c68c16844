"""Schemas of what the sources yield, one for each part of a format."""

ATTACHMENT = "struct<file_name: string, content_type: string, content_id: string, data: binary>"
MAIL = f"`from` string, `to` array<string>, cc array<string>, bcc array<string>, subject string, `date` timestamp, date_offset_min int, message_id string, reply_to string, text_body string, html_body string, attachments array<{ATTACHMENT}>, inline_images map<string, {ATTACHMENT}>, headers map<string, string>"
EVENT = "uid string, summary string, description string, location string, start timestamp, end timestamp, duration string, all_day boolean, created timestamp, last_modified timestamp, rrule string, status string, organizer string, attendees array<string>, extra map<string, string>"
TODO = "uid string, summary string, description string, start timestamp, due timestamp, completed timestamp, percent_complete int, priority int, status string, organizer string, attendees array<string>, extra map<string, string>"
CONTACT = (
    "full_name string, name struct<family: string, given: string, additional: string, prefix: string, suffix: string>, organization string, title string, birthday date, note string, url string, photo string, uid string, revision timestamp, "
    "phones array<struct<number: string, type: string>>, emails array<struct<address: string, type: string>>, "
    "addresses array<struct<po_box: string, extended: string, street: string, city: string, region: string, postal_code: string, country: string, type: string>>, extra map<string, string>"
)
CELL = "sheet string, `row` int, col int, kind string, value string, number double, time timestamp, formula string, style int"
SHEET_ROW = "sheet string, `row` int, cells array<string>"
MERGE = "sheet string, row1 int, col1 int, row2 int, col2 int"
LINK = "sheet string, ref string, url string"
SIZE = "sheet string, axis string, `index` int, size double, outline int"
COMMENT = "sheet string, ref string, author string, text string"
VALIDATION = "sheet string, ref string, type string, operator string, formula1 string, formula2 string, items array<string>"
FORMAT = "sheet string, ref string, type string, operator string, formulas array<string>, colors array<string>, priority int"
TABLE = "sheet string, name string, ref string, columns array<string>, style string"
CHART = "place string, chart_number int, chart_type string, categories array<string>, series array<struct<name: string, `values`: array<double>>>"
PIVOT = "sheet string, source string, rows array<string>, columns array<string>, filters array<string>, data array<struct<field: string, function: string, caption: string>>, items map<string, array<string>>"
NAME = "name string, formula string"
STYLE = "sheet string, `row` int, col int, number_format string, font_name string, font_size double, bold boolean, italic boolean, font_color string, fill string, horizontal string, vertical string, wrap boolean, underline boolean, border map<string, string>"
SHEET_INFO = "sheet string, state string, freeze_rows int, freeze_cols int, auto_filter string, tab_color string, protected boolean, page_setup map<string, string>"
SPARKLINE = "sheet string, type string, ref string, formula string"
WORKBOOK = "protection map<string, string>, calculation map<string, string>, properties map<string, string>, hidden array<string>"
IMAGE = "place string, name string, `row` int, col int, data binary"
PARAGRAPH = "idx int, text string"
BLOCK = "idx int, kind string, style string, level int, align string, text string, runs array<struct<text: string, bold: boolean, italic: boolean, underline: boolean, strike: boolean, color: string, size: double, link: string, image: string>>, `rows` array<array<string>>, alias string"
DOC_TABLE = "idx int, `row` int, cells array<string>"
SHAPE = "slide int, id int, parent int, name string, shape_type string, geometry string, z int, text string, `left` bigint, top bigint, width bigint, height bigint"
DECK_PART = "kind string, number int, name string, xml string"
SLIDE_COMMENT = "slide int, author string, text string, `date` string"
MARGINAL = "kind string, idx int, text string"
SLIDE = "slide int, text string, notes string, transition string"
GLYPH = "page int, text string, x double, y double, font_size double"
PDF_INFO = "title string, author string, subject string, creation_date string, pdf_version string, page_count int, fonts array<string>"
PAGE = "page int, text string"
ANNOTATION = "page int, subtype string, rect array<double>, contents string, uri string"
FIELD = "name string, type string, value string, options array<string>"
BOOKMARK = "ord int, title string, depth int, page int"
FILE = "name string, data binary"
NODE = "node_id int, parent_id int, depth int, ord int, kind string, text string, level int, url string, info string"
CHAPTER = "idx int, title string, content string, file_name string"
PROPERTIES = "properties map<string, string>"
PART = "part string"
STREAM = "stream_path string, data binary"
