"""Old workbooks (BIFF8 in a compound file): rows, links, widths, and a writer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from ..functions import kernels as K
from . import cfb

# Record numbers of the file format.
BOF, EOF, CONTINUE, BOUNDSHEET, SST, LABELSST = 0x809, 0x0A, 0x3C, 0x85, 0xFC, 0xFD
NUMBER, RK, MULRK, BOOLERR, LABEL, FORMULA, STRING = 0x203, 0x27E, 0xBD, 0x205, 0x204, 0x06, 0x207
COLINFO, HLINK, MERGES, PANE, WINDOW2, ROW, CODEPAGE, DIMENSIONS = 0x7D, 0x1B8, 0xE5, 0x41, 0x23E, 0x208, 0x42, 0x200
XF, FONT, STYLE, FORMAT = 0xE0, 0x31, 0x293, 0x41E


def _records(data: bytes, start: int = 0) -> Iterator[tuple[int, bytes, int]]:
    while start + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, start)
        yield kind, data[start + 4 : start + 4 + n], start
        start += 4 + n


class _Strings:
    """The shared strings, which may break off at any place and go on in the next record."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def _raw(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            got = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def read(self) -> list[str]:
        head = self._raw(8)
        count = struct.unpack("<II", head)[1] if len(head) == 8 else 0
        out = []
        while len(out) < count and self.k < len(self.parts):
            head = self._raw(3)
            if len(head) < 3:
                break
            n, flags = struct.unpack("<HB", head)
            runs = struct.unpack("<H", self._raw(2))[0] if flags & 8 else 0
            extra = struct.unpack("<I", self._raw(4))[0] if flags & 4 else 0
            text, wide = "", flags & 1
            while n and self.k < len(self.parts):
                if self.at >= len(self.parts[self.k]):
                    self.k, self.at = self.k + 1, 0
                    if self.k >= len(self.parts):
                        break
                    wide = self._raw(1)[0] & 1  # a continued string says anew how wide its characters are
                size = 2 if wide else 1
                take = min(n, (len(self.parts[self.k]) - self.at) // size)
                if not take:
                    break
                got = self.parts[self.k][self.at : self.at + take * size]
                text += got.decode("utf-16-le" if wide else "latin-1", "replace")
                self.at, n = self.at + take * size, n - take
            self._raw(4 * runs + extra)
            out.append(text)
        return out


def _short(b: bytes, at: int, long: bool = False) -> str:
    n = struct.unpack_from("<H", b, at)[0] if long else b[at]
    at += 2 if long else 1
    wide = b[at] & 1
    return b[at + 1 : at + 1 + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")


class Workbook:
    def __init__(self, data: bytes):
        root = cfb.parse(data)
        self.data = root.stream("Workbook") or root.stream("Book") or b""
        self.sheets: dict[str, int] = {}
        self.strings: list[str] = []
        parts: list[bytes] | None = None
        for kind, b, _ in _records(self.data):
            if kind == CONTINUE and parts is not None:
                parts.append(b)
                continue
            if parts is not None:
                self.strings, parts = _Strings(parts).read(), None
            if kind == BOUNDSHEET:
                self.sheets[_short(b, 6)] = struct.unpack_from("<I", b)[0]
            elif kind == SST:
                parts = [b]
            elif kind == EOF:
                break
        if parts is not None:
            self.strings = _Strings(parts).read()

    def _sheet(self, name: str) -> Iterator[tuple[int, bytes]]:
        if name not in self.sheets:
            return
        depth = 0
        for kind, b, _ in _records(self.data, self.sheets[name]):
            depth += kind == BOF
            if kind == EOF:
                depth -= 1
                if not depth:
                    return
            yield kind, b

    def rows(self, name: str | None = None) -> list[list]:
        """Rows up to the last one used, all as wide as the widest; an unknown sheet has none. Numbers, dates too,
        are doubles; error cells stay empty."""
        name = next(iter(self.sheets), "") if name is None else name
        cells: dict[tuple[int, int], object] = {}
        last = None
        for kind, b in self._sheet(name):
            if kind in (LABELSST, NUMBER, RK, BOOLERR, LABEL, FORMULA):
                at = struct.unpack_from("<HH", b)
            if kind == LABELSST:
                k = struct.unpack_from("<I", b, 6)[0]
                cells[at] = self.strings[k] if k < len(self.strings) else None
            elif kind == NUMBER:
                cells[at] = struct.unpack_from("<d", b, 6)[0]
            elif kind == RK:
                cells[at] = K.decode_rk(struct.unpack_from("<I", b, 6)[0])
            elif kind == MULRK:
                row, first = struct.unpack_from("<HH", b)
                for i in range((len(b) - 6) // 6):
                    cells[(row, first + i)] = K.decode_rk(struct.unpack_from("<I", b, 6 + 6 * i)[0])
            elif kind == BOOLERR and not b[7]:
                cells[at] = bool(b[6])
            elif kind == LABEL:
                cells[at] = _short(b, 6, long=True)
            elif kind == FORMULA:
                if b[12:14] == b"\xff\xff":
                    last = at
                    cells[at] = bool(b[8]) if b[6] == 1 else None
                else:
                    cells[at] = struct.unpack_from("<d", b, 6)[0]
            elif kind == STRING and last:
                cells[last], last = _short(b, 0, long=True), None
        if not cells:
            return []
        width = max(c for _, c in cells) + 1
        out = [[None] * width for _ in range(max(r for r, _ in cells) + 1)]
        for (r, c), v in cells.items():
            out[r][c] = v
        return out

    def widths(self, name: str) -> dict[int, float]:
        return {c: w / 256 for kind, b in self._sheet(name) if kind == COLINFO for a, z, w in [struct.unpack_from("<HHH", b)] for c in range(a, min(z, 255) + 1)}

    def merges(self, name: str) -> list[tuple[int, int, int, int]]:
        out = []
        for kind, b in self._sheet(name):
            if kind == MERGES:
                for i in range(struct.unpack_from("<H", b)[0]):
                    r1, r2, c1, c2 = struct.unpack_from("<HHHH", b, 2 + 8 * i)
                    out.append((r1, c1, r2, c2))
        return out

    def hyperlinks(self, name: str) -> dict[str, str]:
        out = {}
        for kind, b in self._sheet(name):
            if kind == HLINK and len(b) > 52:
                r, _, c = struct.unpack_from("<HHH", b)
                n = struct.unpack_from("<I", b, 48)[0]
                out[f"{K.column_name(c)}{r + 1}"] = b[52 : 52 + n].decode("utf-16-le", "replace").rstrip("\0")
        return out


def sheets(data: bytes) -> list[tuple[str, list[list]]]:
    w = Workbook(data)
    return [(n, w.rows(n)) for n in w.sheets]


def text(data: bytes) -> str | None:
    return K.csv_text(sheets(data))


def markdown(data: bytes) -> str | None:
    return K.md_text(sheets(data))


def _record(kind: int, data: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def _string(s: str, long: bool = True) -> bytes:
    return struct.pack("<H" if long else "<B", len(s)) + b"\1" + s.encode("utf-16-le")


_MONIKER = bytes.fromhex("d0c9ea79f9bace118c8200aa004ba90b"), bytes.fromhex("e0c9ea79f9bace118c8200aa004ba90b")


def build(sheets_: list[tuple[str, list[list]]], widths: dict[int, float] | None = None, merges: list[tuple[int, int, int, int]] = (), freeze: tuple[int, int] | None = None, links: dict[tuple[int, int], str] | None = None) -> bytes:
    """Sheets of texts, numbers and booleans; layout applies to the first sheet."""
    strings: dict[str, int] = {}
    bodies = []
    for k, (_, rows) in enumerate(sheets_):
        width = max((len(r) for r in rows), default=0)
        out = _record(BOF, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 6))
        if k == 0:
            out += b"".join(_record(COLINFO, struct.pack("<HHHHHH", c, c, int(w * 256), 0, 0, 0)) for c, w in (widths or {}).items())
        out += _record(DIMENSIONS, struct.pack("<IIHHH", 0, len(rows), 0, width, 0))
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if v is None:
                    continue
                place = struct.pack("<HHH", r, c, 15)
                if isinstance(v, bool):
                    out += _record(BOOLERR, place + bytes((v, 0)))
                elif isinstance(v, str):
                    out += _record(LABELSST, place + struct.pack("<I", strings.setdefault(v, len(strings))))
                else:
                    out += _record(NUMBER, place + struct.pack("<d", float(v)))
        split = k == 0 and freeze and any(freeze)
        out += _record(WINDOW2, struct.pack("<HHHIHHI", 0x6B6 | (8 if split else 0), 0, 0, 64, 0, 0, 0))
        if split:
            out += _record(PANE, struct.pack("<HHHHH", freeze[1], freeze[0], freeze[0], freeze[1], 0))
        if k == 0 and merges:
            for i in range(0, len(merges), 1024):
                part = merges[i : i + 1024]
                out += _record(MERGES, struct.pack("<H", len(part)) + b"".join(struct.pack("<HHHH", a, c, b, d) for a, b, c, d in part))
        for (r, c), url in (links or {}).items() if k == 0 else ():
            target = (url + "\0").encode("utf-16-le")
            out += _record(HLINK, struct.pack("<HHHH", r, r, c, c) + _MONIKER[0] + struct.pack("<II", 2, 3) + _MONIKER[1] + struct.pack("<I", len(target)) + target)
        bodies.append(out + _record(EOF))
    head = _record(BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 6)) + _record(CODEPAGE, struct.pack("<H", 1200))
    font = struct.pack("<HHHHHBBBB", 200, 0, 0x7FFF, 400, 0, 0, 0, 0, 0) + _string("Arial", long=False)
    head += _record(FONT, font) * 5
    head += b"".join(_record(XF, struct.pack("<HHHBBBBIIH", 0, 0, 0xFFF5 if i < 15 else 1, 0x20, 0, 0, 0, 0, 0, 0x20C0)) for i in range(16))
    head += _record(STYLE, struct.pack("<HBB", 0x8000, 0, 255))
    # the strings go on in further records; a character is never split
    parts, part = [], struct.pack("<II", len(strings), len(strings))
    for s in strings:
        raw = s.encode("utf-16-le")
        if len(part) + 5 > 8200:
            parts.append(part)
            part = b""
        part += struct.pack("<HB", len(raw) // 2, 1)
        while raw:
            room = max(0, 8220 - len(part)) // 2 * 2
            if not room:
                parts.append(part)
                part, room = b"\1", 8200
            part, raw = part + raw[:room], raw[room:]
    parts.append(part)
    shared = _record(SST, parts[0]) + b"".join(_record(CONTINUE, p) for p in parts[1:])
    names = [n[:31].encode("utf-16-le") for n, _ in sheets_]
    start = len(head) + sum(12 + len(n) for n in names) + len(shared) + 4
    bounds = b""
    for n, b in zip(names, bodies, strict=True):
        bounds += _record(BOUNDSHEET, struct.pack("<IHBB", start, 0, len(n) // 2, 1) + n)
        start += len(b)
    root = cfb.Storage("Root Entry")
    root.put("Workbook", head + bounds + shared + _record(EOF) + b"".join(bodies))
    return cfb.build(root)
