"""Plain Python kernels that format code shares. Columns with the same meaning are in columns.py."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import re
import struct
from decimal import Decimal, InvalidOperation

# What a stripped text decodes, in this order, so that a doubly escaped entity decodes twice.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def strip_html(html: str | None) -> str:
    text = re.sub(r"<[^>]+>", " ", html or "")
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return re.sub(r"\s+", " ", text).strip()


def extract_title(html: str) -> str | None:
    for mark in ("<title", "<h1"):
        m = re.search(re.escape(mark) + r"[^>]*>([^<]*)", html, re.IGNORECASE)
        if m and m[1].strip():
            return m[1].strip()
    return None


def column_index(ref: str) -> int:
    """0-based column of the letters at the start of a cell reference; without letters 0."""
    n = 0
    for c in ref:
        if not ("A" <= c.upper() <= "Z"):
            break
        n = n * 26 + ord(c.upper()) - 64
    return max(0, n - 1)


def column_name(index: int) -> str:
    out = ""
    index += 1
    while index > 0:
        index, r = divmod(index - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_ref(ref: str) -> tuple[int, int]:
    """(row, column), both 0-based; a row that isn't a number raises ValueError."""
    m = re.match(r"\$?([A-Za-z]*)\$?(.*)$", ref)
    return int(m[2]) - 1, column_index(m[1])


def range_ref(ref: str) -> tuple[int, int, int, int] | None:
    parts = ref.split(":")
    if len(parts) != 2:
        return None
    return (*cell_ref(parts[0]), *cell_ref(parts[1]))


_REF = re.compile(r"(?<![A-Za-z0-9_.!'])(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(])")


def shift_formula(formula: str, rows: int, columns: int) -> str:
    """Relative references moved by rows and columns; parts behind $ stay, quoted text too."""

    def moved(m: re.Match) -> str:
        column = m[2] if m[1] else column_name(max(0, column_index(m[2]) + columns))
        row = m[4] if m[3] else str(max(1, int(m[4]) + rows))
        return f"{m[1]}{column}{m[3]}{row}"

    return "".join(p if i % 2 else _REF.sub(moved, p) for i, p in enumerate(re.split(r'("(?:[^"]|"")*")', formula)))


EPOCH = dt.datetime(1900, 1, 1)


def date_to_serial(value: dt.datetime) -> float:
    """Days since 1900-01-01 plus 2."""
    d = value - EPOCH
    return d.days + 2 + (d.seconds + d.microseconds / 1e6) / 86400


def serial_to_date(serial: float) -> dt.datetime:
    """To whole seconds, half to even."""
    return EPOCH + dt.timedelta(seconds=round((serial - 2) * 86400))


# Number formats by what a cell becomes; ids are fixed by the file format.
DATE_IDS = frozenset((14, 15, 16, 17, 22))
TIME_IDS = frozenset((18, 19, 20, 21, 45, 46, 47))
GENERAL_IDS = frozenset((0,))
INTEGER_IDS = frozenset((1, 3, 37, 38))
DECIMAL_IDS = frozenset((2, 4, 11, 39, 40))
PERCENT_IDS = frozenset((9, 10))
TEXT_IDS = frozenset((49,))


def _int(text: str) -> int | None:
    t = text.strip()
    return int(t) if re.fullmatch(r"[+-]?[0-9]+", t) and -(2**63) <= int(t) < 2**63 else None


def _float(text: str) -> float | None:
    t = text.strip().replace(",", "")
    return float(t) if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t) else None


def _decimal(text: str) -> Decimal | None:
    try:
        v = Decimal(text.strip().replace(",", ""))
    except InvalidOperation:
        return None
    return v if v.is_finite() and abs(v) < Decimal(2) ** 96 and "e" not in text.lower() else None


def _first(*values):
    return next((v for v in values if v is not None), None)


def typed_value(text: str, format_id: int, code: str | None = None):
    """A cell's text as its number format reads it; what doesn't fit stays text."""
    if format_id in DATE_IDS or (code and ("yy" in code.lower() or "mmm" in code.lower())):
        v = _float(text)
        return serial_to_date(v) if v is not None and -1e6 < v < 2.9e6 else text
    if format_id in TIME_IDS:
        v = _float(text)
        return dt.timedelta(seconds=round(v * 86400)) if v is not None and abs(v) < 1e8 else text
    if format_id in GENERAL_IDS:
        return _first(_int(text), _decimal(text), _float(text), text)
    if format_id in INTEGER_IDS:
        return _first(_int(text), text)
    if format_id in DECIMAL_IDS:
        return _first(_decimal(text), _float(text), text)
    if format_id in PERCENT_IDS:
        return _first(_float(text), text)
    if format_id in TEXT_IDS:
        v = _first(_decimal(text), _float(text))
        return text if v is None else format(v, "f") if isinstance(v, Decimal) else repr(v)
    return text


def plain_value(text: str):
    """A number where the cell has neither style nor type."""
    return _first(_int(text), _float(text), text)


def percent(text: str) -> float | None:
    m = re.fullmatch(r"\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*%\s*", text)
    return float(Decimal(m[1]) / 100) if m else None


INTEGER_DIGITS = 15
FRACTION_DIGITS = 11


def written_as_text(value) -> bool:
    """Numbers that a spreadsheet's double would change go out as text."""
    if isinstance(value, bool):
        return False
    text = format(value, "f") if isinstance(value, Decimal) else str(value)
    if text.lstrip("+-").startswith("0.0000000"):
        return True
    digits = sum(c.isdigit() for c in text)
    return digits > (INTEGER_DIGITS if isinstance(value, int) else FRACTION_DIGITS)


def decode_rk(rk: int) -> float:
    """The 30-bit numbers of old spreadsheets: bit 1 an integer, else the top of a double; bit 0 hundredths."""
    if rk & 2:
        v = float((rk - (1 << 32) if rk & 0x80000000 else rk) >> 2)
    else:
        v = struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", rk & 0xFFFFFFFC))[0]
    return v / 100 if rk & 1 else v


def text_of(value) -> str:
    """A value as extraction prints it."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, dt.timedelta):
        s = int(value.total_seconds())
        sign, s = ("-", -s) if s < 0 else ("", s)
        days, s = divmod(s, 86400)
        return f"{sign}{f'{days}.' if days else ''}{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}"
    return str(value)


def csv_escape(text: str | None) -> str:
    text = text or ""
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def md_escape(text: str | None) -> str:
    return (text or "").replace("|", "\\|").replace("\n", " ").replace("\r", "")


def csv_text(sheets: list[tuple[str, list[list]]]) -> str | None:
    """Sheets as CSV; names as headings if there are several."""
    if not sheets:
        return None
    out = []
    for i, (name, rows) in enumerate(sheets):
        if len(sheets) > 1:
            out += ([""] if i else []) + [f"## {name}"]
        out += [",".join(csv_escape(text_of(v)) for v in row) for row in rows]
    return "".join(line + "\n" for line in out)


def md_table(rows: list[list]) -> list[str]:
    """A pipe table; the first row is the header and gives the width."""
    if not rows:
        return []
    width = len(rows[0])
    line = lambda cells: "|" + "".join(f" {md_escape(text_of(c))} |" for c in cells)
    body = [line([*r[:width], *[None] * (width - len(r))]) for r in rows[1:]]
    return [line(rows[0]), "|" + " --- |" * width, *body]


def md_text(sheets: list[tuple[str, list[list]]]) -> str | None:
    if not sheets:
        return None
    out = []
    for i, (name, rows) in enumerate(sheets):
        if len(sheets) > 1:
            out += ([""] if i else []) + [f"## {name}", ""]
        out += md_table(rows)
    return "".join(line + "\n" for line in out)


EMU_CM = 360_000
EMU_PT = 12_700


def cm_to_emu(cm: float) -> int:
    return int(cm * EMU_CM)


def emu_to_cm(emu: int) -> float:
    return emu / EMU_CM


def pt_to_emu(pt: float) -> int:
    return int(pt * EMU_PT)


def emu_to_pt(emu: int) -> float:
    return emu / EMU_PT


def rgb(text: str | None) -> str | None:
    """An opaque ARGB colour without its alpha; anything else as it is."""
    return text[2:] if text and len(text) == 8 and text[:2].upper() == "FF" else text


def color(text: str | None) -> tuple[int, int, int, int]:
    """(alpha, red, green, blue) of 6 or 8 hex digits, # allowed; black for anything else."""
    t = (text or "").strip().lstrip("#")
    if re.fullmatch(r"[0-9A-Fa-f]{6}", t):
        t = "FF" + t
    if not re.fullmatch(r"[0-9A-Fa-f]{8}", t):
        return 255, 0, 0, 0
    return tuple(int(t[i : i + 2], 16) for i in (0, 2, 4, 6))


def combine_path(base: str, target: str) -> str:
    """A relationship's target, resolved against the folder of its part."""
    if target.startswith("/"):
        parts: list[str] = []
    else:
        parts = [p for p in base.replace("\\", "/").split("/") if p]
    for p in target.replace("\\", "/").split("/"):
        if p == "..":
            parts[-1:] = []
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def fold_utf8(line: str, first: int = 75, rest: int = 74) -> list[str]:
    """A line in parts of so many UTF-8 bytes at most; characters stay whole."""
    out, size, start, room = [], 0, 0, first
    for i, c in enumerate(line):
        n = len(c.encode("utf-8", "surrogatepass"))
        if size + n > room:
            out.append(line[start:i])
            start, size, room = i, 0, rest
        size += n
    return [*out, line[start:]]


def unfold(text: str) -> list[str]:
    """Lines, continuation lines joined; blank lines dropped."""
    out: list[str] = []
    for line in re.split(r"\r\n|\r|\n", text):
        if line[:1] in (" ", "\t") and out:
            out[-1] += line[1:]
        elif line:
            out.append(line)
    return out


def quoted_printable(data: bytes) -> bytes:
    return binascii.a2b_qp(data)


def from_base64(text: str) -> bytes | None:
    try:
        return base64.b64decode(re.sub(r"\s+", "", text), validate=True)
    except (binascii.Error, ValueError):
        return None
