"""Old Word documents (piece table in a compound file) and old presentations (record tree)."""

from __future__ import annotations

import re
import struct

from . import cfb

CELL = "\x07"


def full_text(data: bytes) -> str:
    """The main text: pieces of Latin-1 or UTF-16 in order; paragraph, page and line ends become newlines, field
    codes go and their results stay."""
    root = cfb.parse(data)
    main = root.stream("WordDocument") or b""
    if len(main) < 0x1AA:
        return ""
    flags = struct.unpack_from("<H", main, 0x0A)[0]
    table = root.stream("1Table" if flags & 0x200 else "0Table") or b""
    count = struct.unpack_from("<i", main, 0x4C)[0]
    start, size = struct.unpack_from("<II", main, 0x1A2)
    clx, at, out = table[start : start + size], 0, []
    while at < len(clx):
        if clx[at] == 1:
            at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
        elif clx[at] == 2:
            n = struct.unpack_from("<I", clx, at + 1)[0]
            plc = clx[at + 5 : at + 5 + n]
            k = (n - 4) // 12
            ends = struct.unpack_from(f"<{k + 1}I", plc)
            for i in range(k):
                fc = struct.unpack_from("<I", plc, 4 * (k + 1) + 8 * i + 2)[0]
                chars = ends[i + 1] - ends[i]
                if fc & 0x40000000:
                    place = (fc & 0x3FFFFFFF) // 2
                    out.append(main[place : place + chars].decode("cp1252", "replace"))
                else:
                    out.append(main[fc : fc + 2 * chars].decode("utf-16-le", "replace"))
            break
        else:
            break
    text = "".join(out)
    return _cleaned(text[:count] if count > 0 else text)


def _cleaned(text: str) -> str:
    out, depth, hidden = [], 0, []
    for c in text:
        if c == "\x13":
            depth += 1
            hidden.append(True)
        elif c == "\x14":
            if hidden:
                hidden[-1] = False
        elif c == "\x15":
            if hidden:
                hidden.pop()
        elif not any(hidden):
            out.append("\n" if c in "\r\x0c\x0b" else "" if c in "\x01\x02\x05\x08" else c)
    return "".join(out)


def paragraphs(data: bytes) -> list[str]:
    """Lines without table marks; empty ones dropped."""
    return [p for line in full_text(data).split("\n") if (p := line.replace(CELL, " ").strip())]


def tables(data: bytes) -> list[list[list[str]]]:
    """Neighbouring lines with cell marks are a table; each double mark ends a row; other lines end the table."""
    out: list[list[list[str]]] = []
    rows: list[list[str]] = []
    for line in [*full_text(data).split("\n"), ""]:
        if CELL in line:
            for row in line.split(CELL * 2):
                cells = [c.strip() for c in row.split(CELL)]
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    rows.append(cells)
        elif rows:
            out.append(rows)
            rows = []
    return out


def text(data: bytes) -> str:
    return "\n".join(paragraphs(data))


def markdown(data: bytes) -> str:
    return "".join(p + "\n\n" for p in paragraphs(data))


# Record types of old presentations.
SLIDE, TEXT_CHARS, TEXT_BYTES, CSTRING, SLIDE_LIST, PERSIST = 0x03EE, 0x0FA0, 0x0FA8, 0x0FBA, 0x0FF0, 0x03F3


def slide_texts(data: bytes) -> list[str]:
    """Texts of each slide: those in the slides themselves and, by slide, those of the document's slide list."""
    stream = cfb.parse(data).stream("PowerPoint Document") or b""
    own: list[list[str]] = []
    listed: list[list[str]] = []

    def clean(s: str) -> str:
        return re.sub("[\r\x0b]", "\n", s).strip("\0")

    def walk(at: int, end: int, into: list[str] | None, depth: int) -> None:
        while at + 8 <= end:
            head, kind, n = struct.unpack_from("<HHI", stream, at)
            a, b = at + 8, min(end, at + 8 + n)
            if kind == PERSIST and depth and into is None:
                listed.append([])
            elif kind in (TEXT_CHARS, TEXT_BYTES):
                t = clean(stream[a:b].decode("utf-16-le" if kind == TEXT_CHARS else "latin-1", "replace"))
                target = into if into is not None else listed[-1] if listed else None
                if t and target is not None:
                    target.append(t)
            elif head & 0xF == 0xF and depth < 64:
                if kind == SLIDE:
                    own.append([])
                    walk(a, b, own[-1], depth + 1)
                elif kind != SLIDE_LIST or head >> 4 == 0:  # instance 0 lists the slides, others masters and notes
                    walk(a, b, into, depth + 1)
            at += 8 + n

    walk(0, len(stream), None, 0)
    if not own:
        return ["\n".join(t) for t in listed if t]
    return ["\n".join((listed[k] if k < len(listed) else []) + t) for k, t in enumerate(own)]


def ppt_text(data: bytes) -> str | None:
    slides = slide_texts(data)
    return "\n".join(slides) if slides else None


def ppt_markdown(data: bytes) -> str | None:
    slides = slide_texts(data)
    return "\n".join(f"## 幻灯片 {k + 1}\n\n{t}\n" for k, t in enumerate(slides)) if slides else None
