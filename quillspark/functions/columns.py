"""The kernels as Columns: built-in functions only, so they stay inside the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import EMU_CM, EMU_PT, ENTITIES

SUPPORTED = ("xlsx", "xls", "docx", "doc", "pptx", "ppt", "pdf", "rtf", "ods", "epub", "vcf", "eml", "ics", "md", "xps")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_supported(extension) -> Column:
    """Dot optional, any case; null and blank are not supported."""
    e = F.lower(F.trim(_col(extension)))
    return F.coalesce(F.regexp_replace(e, r"^\.", "").isin(*SUPPORTED), F.lit(False))


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"\.([^./\\]+)$", 1))


def strip_html(html) -> Column:
    c = F.regexp_replace(F.coalesce(_col(html), F.lit("")), "<[^>]+>", " ")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def extract_title(html) -> Column:
    """<title>, else <h1>, up to the next tag; empty as null."""
    part = lambda tag: F.nullif(F.trim(F.regexp_extract(_col(html), rf"(?i)<{tag}[^>]*>([^<]*)", 1)), F.lit(""))
    return F.coalesce(part("title"), part("h1"))


def csv_escape(c) -> Column:
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def md_escape(c) -> Column:
    c = F.replace(F.coalesce(_col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


def csv_line(*columns) -> Column:
    return F.concat_ws(",", *[csv_escape(_col(c).cast("string")) for c in columns])


def md_line(*columns) -> Column:
    return F.concat(F.lit("|"), *[F.concat(F.lit(" "), md_escape(_col(c).cast("string")), F.lit(" |")) for c in columns])


def column_index(ref) -> Column:
    """0-based column of a reference's letters; 0 without letters."""
    letters = F.regexp_extract(F.upper(_col(ref)), "^([A-Z]*)", 1)
    n = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)
    return F.greatest(n - 1, F.lit(0))


def column_name(index, letters: int = 7) -> Column:
    """0-based index to letters: at most `letters`, enough for any 31-bit index."""
    i = _col(index).cast("bigint")
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.concat(F.char(65 + (a["n"] - 1) % 26), a["s"]).alias("s"), F.floor((a["n"] - 1) / 26).alias("n"))).otherwise(a)
    start = F.struct(F.lit("").alias("s"), (i + 1).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(letters)), start, step, lambda a: a["s"])


def cell_ref(ref) -> Column:
    """struct(row, col), 0-based; a bad row is null."""
    row = F.regexp_extract(_col(ref), "([0-9]+)$", 1).try_cast("int") - 1
    return F.struct(row.alias("row"), column_index(ref).alias("col"))


def date_to_serial(ts) -> Column:
    """Days since 1900-01-01 plus 2, with the fraction of the day."""
    days = F.unix_micros(_col(ts).cast("timestamp")) / 86_400_000_000
    return days + 25567 + 2


def serial_to_date(serial) -> Column:
    """To whole seconds, half to even."""
    seconds = F.bround((_col(serial) - 2 - 25567) * 86400, 0)
    return F.timestamp_seconds(seconds)


def percent(text) -> Column:
    m = F.regexp_extract(_col(text), r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*%\s*$", 1)
    return m.try_cast("double") / 100


def written_as_text(value, kind: str) -> Column:
    text = _col(value).cast("string")
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    return (digits > (15 if kind == "integer" else 11)) | F.regexp_replace(text, "^[+-]", "").startswith("0.0000000")


def decode_rk(rk) -> Column:
    """Of the integer kind by shifting, of the other from the top bits of a double."""
    r = _col(rk).cast("bigint")
    signed = F.when(r >= 2**31, r - 2**32).otherwise(r)
    bits = F.shiftleft(r.bitwiseAND(0xFFFFFFFC), 32)
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(bits, 52).bitwiseAND(0x7FF)
    fraction = bits.bitwiseAND((1 << 52) - 1).cast("double") / float(1 << 52)
    normal = sign * (1 + fraction) * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    real = F.when((exponent == 0), sign * fraction * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise(normal)
    whole = F.shiftright(signed, 2).cast("double")
    v = F.when(r.bitwiseAND(2) != 0, whole).otherwise(real)
    return F.when(r.bitwiseAND(1) != 0, v / 100).otherwise(v)


def cm_to_emu(cm) -> Column:
    return (_col(cm) * EMU_CM).cast("bigint")


def emu_to_cm(emu) -> Column:
    return _col(emu) / EMU_CM


def pt_to_emu(pt) -> Column:
    return (_col(pt) * EMU_PT).cast("bigint")


def emu_to_pt(emu) -> Column:
    return _col(emu) / EMU_PT


def rgb(c) -> Column:
    return F.when((F.length(_col(c)) == 8) & F.upper(_col(c)).startswith("FF"), F.substring(_col(c), 3, 6)).otherwise(_col(c))


def field(data_columns: list[str], name: str, display: str | None = None, description: str | None = None) -> str | None:
    """The header that feeds a field: its name in any case, else its display name, else its description, exactly."""
    for want, match in ((name, lambda h, w: h.lower() == w.lower()), (display, str.__eq__), (description, str.__eq__)):
        found = want and next((h for h in data_columns if match(h, want)), None)
        if found:
            return found
    return None
