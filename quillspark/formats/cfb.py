"""Compound files: a tree of storages and streams, read and written."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE, END, FAT, DIFAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
NONE = 0xFFFFFFFF
SECTOR, MINI, CUTOFF = 512, 64, 4096


@dataclass
class Storage:
    name: str
    children: dict[str, Storage | bytes] = field(default_factory=dict)

    def storage(self, path: str, make: bool = False) -> Storage | None:
        """A storage by its path of exact names."""
        at: Storage | bytes | None = self
        for name in (p for p in path.split("/") if p):
            if not isinstance(at, Storage):
                return None
            if make and name not in at.children:
                at.children[name] = Storage(name)
            at = at.children.get(name)
        return at if isinstance(at, Storage) else None

    def stream(self, path: str) -> bytes | None:
        folder, _, name = path.strip("/").rpartition("/")
        at = self.storage(folder)
        data = at.children.get(name) if at else None
        return data if isinstance(data, bytes) else None

    def put(self, path: str, data: bytes) -> None:
        folder, _, name = path.strip("/").rpartition("/")
        at = self.storage(folder, make=True)
        if at is None:
            raise ValueError(f"{folder} is a stream")
        at.children[name] = data

    def walk(self, prefix: str = "") -> list[tuple[str, bytes]]:
        out = []
        for name, c in self.children.items():
            path = f"{prefix}/{name}" if prefix else name
            out += c.walk(path) if isinstance(c, Storage) else [(path, c)]
        return out


def _chain(table: list[int], start: int) -> list[int]:
    """A chain of sectors; one that returns to itself ends there."""
    out, seen = [], set()
    while start < len(table) and start not in seen:
        seen.add(start)
        out.append(start)
        start = table[start]
    return out


def parse(data: bytes) -> Storage:
    if len(data) < SECTOR or data[:8] != SIGNATURE:
        raise ValueError("not a compound file")
    (shift, mini_shift), first_dir, cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<HH", data, 30), *struct.unpack_from("<I", data, 48), *struct.unpack_from("<I", data, 56), *struct.unpack_from("<IIII", data, 60)
    size, mini = 1 << min(shift, 16), 1 << min(mini_shift, 12)
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    words = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    total = max(0, len(data) // size - 1) + 1
    fat_sectors, at, seen = words(data[76:512]), first_difat, set()
    while at < total and at not in seen and len(seen) <= n_difat:
        seen.add(at)
        more = words(sector(at))
        fat_sectors += more[:-1]
        at = more[-1] if more else END
    table = [w for k in fat_sectors if k < total for w in words(sector(k))]
    read = lambda start: b"".join(map(sector, _chain(table, start)))
    directory = read(first_dir)
    minis = words(read(first_mini)) if n_mini else []
    entries = [directory[i : i + 128] for i in range(0, len(directory) - 127, 128)]
    if not entries:
        raise ValueError("no directory")

    def info(k: int):
        e = entries[k]
        n = struct.unpack_from("<H", e, 64)[0]
        left, right, child = struct.unpack_from("<III", e, 68)
        start, length = struct.unpack_from("<IQ", e, 116)
        return e[: max(0, min(64, n) - 2)].decode("utf-16-le", "replace"), e[66], left, right, child, start, length & 0xFFFFFFFF if size == 512 else length

    *_, root_start, root_size = info(0)
    mini_data = read(root_start)[:root_size]

    def content(start: int, length: int) -> bytes:
        if length < cutoff:
            return b"".join(mini_data[k * mini : (k + 1) * mini] for k in _chain(minis, start))[:length]
        return read(start)[:length]

    def fill(storage: Storage, k: int, used: set[int]) -> None:
        todo = [k]
        while todo:
            k = todo.pop()
            if k >= len(entries) or k in used:
                continue
            used.add(k)
            name, kind, left, right, child, start, length = info(k)
            todo += [right, left]
            if kind == 1:
                inner = storage.children[name] = Storage(name)
                fill(inner, child, used)
            elif kind == 2:
                storage.children[name] = content(start, length)

    root = Storage("Root Entry")
    fill(root, info(0)[4], {0})
    return root


def build(root: Storage) -> bytes:
    """Version 3, sectors of 512 bytes; siblings hang in a balanced tree in the order that readers expect."""
    order = lambda name: (len(name.encode("utf-16-le")), name.upper())
    entries: list[dict] = []

    def add(name: str, kind: int, data: bytes = b"") -> int:
        entries.append({"name": name, "kind": kind, "data": data, "left": NONE, "right": NONE, "child": NONE, "start": END if kind == 2 else 0, "size": len(data)})
        return len(entries) - 1

    def tree(ids: list[int]) -> int:
        if not ids:
            return NONE
        m = len(ids) // 2
        entries[ids[m]]["left"], entries[ids[m]]["right"] = tree(ids[:m]), tree(ids[m + 1 :])
        return ids[m]

    def store(s: Storage, me: int) -> None:
        ids = []
        for name in sorted(s.children, key=order):
            c = s.children[name]
            k = add(name, 1 if isinstance(c, Storage) else 2, b"" if isinstance(c, Storage) else c)
            ids.append(k)
            if isinstance(c, Storage):
                store(c, k)
        entries[me]["child"] = tree(ids)

    store(root, add("Root Entry", 5))
    fat: list[int] = []
    body: list[bytes] = []

    def sectors(data: bytes) -> int:
        n = -(-len(data) // SECTOR)
        if not n:
            return END
        start = len(fat)
        fat.extend([*range(start + 1, start + n), END])
        body.append(data.ljust(n * SECTOR, b"\0"))
        return start

    minis, mini_data = [], bytearray()
    for e in entries:
        if e["kind"] == 2 and e["data"]:
            if len(e["data"]) >= CUTOFF:
                e["start"] = sectors(e["data"])
            else:
                n = -(-len(e["data"]) // MINI)
                e["start"] = len(minis)
                minis += [*range(len(minis) + 1, len(minis) + n), END]
                mini_data += e["data"].ljust(n * MINI, b"\0")
    entries[0]["start"], entries[0]["size"] = sectors(bytes(mini_data)), len(mini_data)
    pack = lambda xs: struct.pack(f"<{len(xs)}I", *xs)
    padded = minis + [FREE] * (-len(minis) % 128)
    first_mini = sectors(pack(padded)) if minis else END
    records = b""
    for e in entries:
        name = e["name"][:31].encode("utf-16-le")
        records += name.ljust(64, b"\0") + struct.pack("<HBBIII", len(name) + 2, e["kind"], 1, e["left"], e["right"], e["child"]) + bytes(36) + struct.pack("<IQ", e["start"], e["size"])
    records += (bytes(64) + struct.pack("<HBBIII", 0, 0, 0, NONE, NONE, NONE) + bytes(48)) * (-len(entries) % 4)
    first_dir = sectors(records)
    n_fat = n_difat = 0
    while True:
        total = len(fat) + n_fat + n_difat
        need = -(-total // 128)
        more = max(0, -(-(need - 109) // 127))
        if (need, more) == (n_fat, n_difat):
            break
        n_fat, n_difat = need, more
    first_fat = len(fat)
    table = fat + [FAT] * n_fat + [DIFAT] * n_difat
    table += [FREE] * (n_fat * 128 - len(table))
    places = list(range(first_fat, first_fat + n_fat))
    difat = b""
    rest = places[109:]
    for i in range(n_difat):
        part = rest[i * 127 : (i + 1) * 127]
        difat += pack(part + [FREE] * (127 - len(part)) + [first_fat + n_fat + i + 1 if i + 1 < n_difat else END])
    head = SIGNATURE + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, first_dir, 0, CUTOFF, first_mini, len(padded) // 128, first_fat + n_fat if n_difat else END, n_difat)
    head += pack((places + [FREE] * 109)[:109])
    return head + b"".join(body) + pack(table) + difat
