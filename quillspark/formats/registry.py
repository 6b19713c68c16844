"""Formats by extension: what reads a file's text, Markdown and tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from . import calendar, contacts, doc, docx, epub, mail, markdown, msg, ods, pdf, pptx, rtf, xls, xlsx, xps


class Format(Protocol):
    """Text and Markdown of a file's bytes; None where a file has none."""

    text: Callable[[bytes], str | None]
    markdown: Callable[[bytes], str | None]


class _Plain:
    def __init__(self, text, markdown, sheets=None):
        self.text, self.markdown, self.sheets = text, markdown, sheets


def _decoded(data: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    return data.decode("utf-8", "replace")


def _parsed(parse, module, decode: bool = False):
    own = (lambda d: parse(_decoded(d))) if decode else parse
    return _Plain(lambda d: module.text(own(d)), lambda d: module.markdown(own(d)))


FORMATS: dict[str, Format] = {
    "xlsx": _Plain(xlsx.text, xlsx.markdown, xlsx.sheets),
    "xls": _Plain(xls.text, xls.markdown, xls.sheets),
    "ods": _Plain(ods.text, ods.markdown, ods.sheets),
    "docx": _Plain(docx.text, docx.markdown),
    "doc": _Plain(doc.text, doc.markdown),
    "pptx": _Plain(pptx.text, pptx.markdown),
    "ppt": _Plain(doc.ppt_text, doc.ppt_markdown),
    "pdf": _Plain(pdf.text, pdf.markdown),
    "rtf": _parsed(rtf.parse, rtf),
    "epub": _parsed(epub.parse, epub),
    "vcf": _parsed(contacts.parse, contacts, decode=True),
    "eml": _parsed(mail.parse, mail),
    "ics": _parsed(calendar.parse, calendar, decode=True),
    "md": _parsed(markdown.parse, markdown, decode=True),
    "xps": _parsed(xps.parse, xps),
}
# Read on request, but not among the supported extensions.
UNLISTED: dict[str, Format] = {"msg": _parsed(msg.parse, msg)}


def normal(extension: str | None) -> str:
    return (extension or "").strip().lower().removeprefix(".")


def is_supported(extension: str | None) -> bool:
    return normal(extension) in FORMATS


def reader(extension: str | None) -> Format | None:
    """The format of an extension; None where it isn't supported."""
    return FORMATS.get(normal(extension)) or UNLISTED.get(normal(extension))


def read_text(data: bytes | None, extension: str | None) -> str | None:
    f = reader(extension)
    return f.text(data) if f and data is not None else None


def read_markdown(data: bytes | None, extension: str | None) -> str | None:
    f = reader(extension)
    return f.markdown(data) if f and data is not None else None


def read_sheets(data: bytes, extension: str) -> list[tuple[str, list[list]]]:
    f = reader(extension)
    return f.sheets(data) if f and getattr(f, "sheets", None) else []
