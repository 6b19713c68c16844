"""QR codes of texts (byte mode, correction level M, versions 1 to 10), as matrices and PNG images."""

from __future__ import annotations

import struct
import zlib

# Fixed values of the standard for level M: correction words of a block, then blocks as (count, data words).
BLOCKS = {
    1: (10, [(1, 16)]), 2: (16, [(1, 28)]), 3: (26, [(1, 44)]), 4: (18, [(2, 32)]), 5: (24, [(2, 43)]),
    6: (16, [(4, 27)]), 7: (18, [(4, 31)]), 8: (22, [(2, 38), (2, 39)]), 9: (22, [(3, 36), (2, 37)]), 10: (26, [(4, 43), (1, 44)]),
}
ALIGNMENT = {1: [], 2: [6, 18], 3: [6, 22], 4: [6, 26], 5: [6, 30], 6: [6, 34], 7: [6, 22, 38], 8: [6, 24, 42], 9: [6, 26, 46], 10: [6, 28, 50]}
MASKS = (
    lambda r, c: (r + c) % 2 == 0, lambda r, c: r % 2 == 0, lambda r, c: c % 3 == 0, lambda r, c: (r + c) % 3 == 0,
    lambda r, c: (r // 2 + c // 3) % 2 == 0, lambda r, c: r * c % 2 + r * c % 3 == 0, lambda r, c: (r * c % 2 + r * c % 3) % 2 == 0, lambda r, c: ((r + c) % 2 + r * c % 3) % 2 == 0,
)

_EXP, _LOG = [1] * 512, [0] * 256
for _i in range(1, 512):
    _EXP[_i] = (_EXP[_i - 1] << 1) ^ (0x11D if _EXP[_i - 1] & 0x80 else 0)
for _i in range(255):
    _LOG[_EXP[_i]] = _i


def _correction(data: list[int], n: int) -> list[int]:
    generator = [1]
    for i in range(n):
        nxt = [*generator, 0]
        for j, g in enumerate(generator):
            nxt[j + 1] ^= _EXP[_LOG[g] + i] if g else 0
        generator = nxt
    rest = [*data, *[0] * n]
    for i in range(len(data)):
        factor = rest[i]
        if factor:
            for j, g in enumerate(generator):
                rest[i + j] ^= _EXP[_LOG[g] + _LOG[factor]]
    return rest[len(data) :]


def _remainder(value: int, bits: int, poly: int) -> int:
    out = value << bits
    while out.bit_length() > bits:
        out ^= poly << (out.bit_length() - bits - 1)
    return value << bits | out


def _words(data: bytes) -> tuple[int, list[int]]:
    for version, (n, blocks) in BLOCKS.items():
        room = sum(k * w for k, w in blocks)
        head = 8 if version < 10 else 16
        if len(data) <= room - 2 - (head == 16):
            break
    else:
        raise ValueError("too long for a version 10 code")
    bits = "0100" + format(len(data), f"0{head}b") + "".join(format(b, "08b") for b in data)
    bits += "0" * min(4, room * 8 - len(bits))
    bits += "0" * (-len(bits) % 8)
    words = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
    words += [(0xEC, 0x11)[i % 2] for i in range(room - len(words))]
    parts, at = [], 0
    for k, w in blocks:
        for _ in range(k):
            parts.append(words[at : at + w])
            at += w
    extra = [_correction(p, n) for p in parts]
    out = [p[i] for i in range(max(map(len, parts))) for p in parts if i < len(p)]
    return version, out + [e[i] for i in range(n) for e in extra]


def matrix(text: str) -> list[list[bool]]:
    """Dark modules of the smallest code that holds the text, with the mask of the least penalty."""
    version, words = _words(text.encode())
    size = 17 + 4 * version
    fixed: dict[tuple[int, int], bool] = {}

    def square(r: int, c: int, radius: int, dark) -> None:
        for i in range(-radius, radius + 1):
            for j in range(-radius, radius + 1):
                if 0 <= r + i < size and 0 <= c + j < size:
                    fixed[(r + i, c + j)] = dark(max(abs(i), abs(j)))

    for i in range(size):
        fixed[(6, i)] = fixed[(i, 6)] = i % 2 == 0
    places = ALIGNMENT[version]
    for r in places:
        for c in places:
            if (r, c) not in ((6, 6), (6, size - 7), (size - 7, 6)):
                square(r, c, 2, lambda d: d != 1)
    for r, c in ((3, 3), (3, size - 4), (size - 4, 3)):
        square(r, c, 4, lambda d: d in (0, 1, 3))
    fixed[(size - 8, 8)] = True
    if version >= 7:
        info = _remainder(version, 12, 0x1F25)
        for i in range(18):
            fixed[(i // 3, size - 11 + i % 3)] = fixed[(size - 11 + i % 3, i // 3)] = bool(info >> i & 1)
    around = [(8, i) for i in (0, 1, 2, 3, 4, 5, 7, 8)] + [(i, 8) for i in (7, 5, 4, 3, 2, 1, 0)]
    split = [(size - 1 - i, 8) for i in range(7)] + [(8, size - 8 + i) for i in range(8)]
    for p in around + split:
        fixed.setdefault(p, False)
    bits = [w >> k & 1 for w in words for k in range(7, -1, -1)]
    free, up = [], True
    for right in [c for c in range(size - 1, 6, -2)] + [5, 3, 1]:
        for r in range(size - 1, -1, -1) if up else range(size):
            free += [(r, c) for c in (right, right - 1) if (r, c) not in fixed]
        up = not up
    best = None
    for k, mask in enumerate(MASKS):
        grid = dict(fixed)
        for i, p in enumerate(free):
            grid[p] = bool((bits[i] if i < len(bits) else 0) ^ mask(*p))
        form = _remainder(k, 10, 0x537) ^ 0x5412  # level M has the bits 00
        for i in range(15):
            grid[around[i]] = grid[split[i]] = bool(form >> (14 - i) & 1)
        rows = [[grid[(r, c)] for c in range(size)] for r in range(size)]
        cost = _penalty(rows)
        if best is None or cost < best[0]:
            best = (cost, rows)
    return best[1]


def _penalty(rows: list[list[bool]]) -> int:
    size, cost = len(rows), 0
    for lines in (rows, [list(c) for c in zip(*rows, strict=True)]):
        for line in lines:
            s = "".join("1" if x else "0" for x in line)
            run = 1
            for a, b in zip(s, s[1:] + "x", strict=True):
                if a == b:
                    run += 1
                else:
                    cost += run - 2 if run >= 5 else 0
                    run = 1
            cost += 40 * (s.count("00001011101") + s.count("10111010000"))
    cost += 3 * sum(rows[r][c] == rows[r][c + 1] == rows[r + 1][c] == rows[r + 1][c + 1] for r in range(size - 1) for c in range(size - 1))
    dark = sum(map(sum, rows))
    return cost + 10 * (abs(20 * dark - 10 * size * size) // (size * size))


def png(text: str, scale: int = 4, border: int = 4) -> bytes:
    """The code as a PNG image of one bit a pixel's worth of grey."""
    rows = matrix(text)
    width = (len(rows) + 2 * border) * scale
    blank = [False] * (len(rows) + 2 * border)
    lines = [blank] * border + [[False] * border + r + [False] * border for r in rows] + [blank] * border
    raw = b"".join((b"\0" + b"".join((b"\0" if x else b"\xff") * scale for x in line)) * scale for line in lines)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
