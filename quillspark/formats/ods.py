"""OpenDocument spreadsheets: rows of texts, merged ranges, and a writer."""

from __future__ import annotations

import re

from ..functions import kernels as K
from .xml import HEAD, Package, attr, esc, every, local, package, qattr
from .xml import text as inner

MOST_REPEATS = 1 << 20
NS = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for p, n in (("office", "office"), ("table", "table"), ("text", "text"), ("style", "style")))


def _repeat(e, name: str) -> int:
    v = attr(e, name) or "1"
    return max(1, min(MOST_REPEATS, int(v))) if v.isdigit() else 1


def _value(c) -> str:
    kind = attr(c, "value-type")
    if kind in ("float", "currency", "percentage"):
        return attr(c, "value") or ""
    if kind == "boolean":
        return attr(c, "boolean-value") or ""
    if kind == "date":
        return attr(c, "date-value") or ""
    if kind == "time":
        return attr(c, "time-value") or ""
    return "\n".join(inner(p) for p in c if local(p) == "p")


def parse(data: bytes) -> list[dict]:
    """Sheets with name, rows (trailing empty cells cut), merges and formulas. Repeated empty rows at the end go."""
    root = Package(data).xml("content.xml")
    out = []
    for t in every(root, "table"):
        rows: list[list[str]] = []
        merges, formulas = [], {}
        for r in every(t, "table-row"):
            cells: list[str] = []
            for c in r:
                if local(c) not in ("table-cell", "covered-table-cell"):
                    continue
                n, v = _repeat(c, "number-columns-repeated"), _value(c)
                wide, high = _repeat(c, "number-columns-spanned"), _repeat(c, "number-rows-spanned")
                if wide > 1 or high > 1:
                    merges.append((len(rows), len(cells), len(rows) + high - 1, len(cells) + wide - 1))
                if attr(c, "formula"):
                    formulas[(len(rows), len(cells))] = attr(c, "formula")
                # a long empty run is only padding up to the sheet's edge
                cells += [v] * (n if v or n < 1024 else 0)
            while cells and not cells[-1]:
                cells.pop()
            n = _repeat(r, "number-rows-repeated")
            if cells or n == 1:
                rows += [list(cells) for _ in range(n)]
        while rows and not rows[-1]:
            rows.pop()
        out.append({"name": attr(t, "name") or f"Sheet{len(out) + 1}", "rows": rows, "merges": merges, "formulas": formulas})
    return out


def sheets(data: bytes) -> list[tuple[str, list[list]]]:
    return [(s["name"], s["rows"]) for s in parse(data)]


def text(data: bytes) -> str | None:
    return K.csv_text(sheets(data))


def markdown(data: bytes) -> str | None:
    return K.md_text(sheets(data))


_NUMBER = re.compile(r"\s*[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)?(?:\.[0-9]+)?\s*")


def _cell(value, span: tuple[int, int] | None) -> str:
    s = K.text_of(value)
    attrs = f' table:number-rows-spanned="{span[0]}" table:number-columns-spanned="{span[1]}"' if span else ""
    body = "".join(f"<text:p>{esc(line)}</text:p>" for line in s.split("\n"))
    if not s:
        return f"<table:table-cell{attrs}/>"
    if s.startswith("="):
        return f"<table:table-cell{attrs} table:formula={qattr('of:' + s)}>{body}</table:table-cell>"
    if isinstance(value, bool) or s.lower() in ("true", "false"):
        return f'<table:table-cell{attrs} office:value-type="boolean" office:boolean-value="{s.lower()}">{body}</table:table-cell>'
    if _NUMBER.fullmatch(s) and any(c.isdigit() for c in s) and not (isinstance(value, str) and re.match(r"[+-]?0[0-9]", s.strip())):
        return f'<table:table-cell{attrs} office:value-type="float" office:value="{s.strip().replace(",", "")}">{body}</table:table-cell>'
    return f'<table:table-cell{attrs} office:value-type="string">{body}</table:table-cell>'


def build(sheets_: list[tuple[str, list[list]]], merges: dict[str, list[tuple[int, int, int, int]]] | None = None) -> bytes:
    tables = ""
    for name, rows in sheets_:
        spans = {(a, b): (c - a + 1, d - b + 1) for a, b, c, d in (merges or {}).get(name, ())}
        covered = {(r, c) for (a, b), (h, w) in spans.items() for r in range(a, a + h) for c in range(b, b + w)} - spans.keys()
        body = ""
        for i, r in enumerate(rows):
            cells = "".join("<table:covered-table-cell/>" if (i, j) in covered else _cell(v, spans.get((i, j))) for j, v in enumerate(r))
            body += f"<table:table-row>{cells or '<table:table-cell/>'}</table:table-row>"
        tables += f"<table:table table:name={qattr(name)}>{body}</table:table>"
    content = f'{HEAD}<office:document-content {NS} office:version="1.2"><office:body><office:spreadsheet>{tables}</office:spreadsheet></office:body></office:document-content>'
    mime = "application/vnd.oasis.opendocument.spreadsheet"
    manifest = f'{HEAD}<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.2"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return package({"mimetype": mime, "content.xml": content, "META-INF/manifest.xml": manifest}, ("mimetype",))


def column_names(header: list[str]) -> list[str]:
    return [h or f"Column{i + 1}" for i, h in enumerate(header)]


