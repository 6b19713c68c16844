"""XML and zip packages, with bounds against hostile input."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

PART_BYTES = 1 << 28  # of one part, unpacked
DOCTYPE = re.compile(rb"<!DOCTYPE", re.IGNORECASE)


def parse(data: bytes) -> ET.Element:
    """The root. Document types are refused, and with them all entities of their own."""
    if DOCTYPE.search(data[:4096]):
        raise ValueError("document types are not read")
    return ET.fromstring(data)


@functools.lru_cache(4096)
def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def local(e: ET.Element) -> str:
    return _local(e.tag)


def attr(e: ET.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    if name in e.attrib:
        return e.attrib[name]
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def find(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def children(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e if _local(c.tag) == name] if e is not None else []


def every(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if _local(c.tag) == name] if e is not None else []


def text(e: ET.Element | None) -> str:
    return "".join(e.itertext()) if e is not None else ""


class Package:
    """A zip file's parts; names are matched in any case, as writers differ."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = self.zip.namelist()
        self._at = {n.replace("\\", "/").lstrip("/").lower(): n for n in self.names}

    def __contains__(self, name: str) -> bool:
        return name.lstrip("/").lower() in self._at

    def read(self, name: str) -> bytes | None:
        real = self._at.get(name.lstrip("/").lower())
        if real is None:
            return None
        if self.zip.getinfo(real).file_size > PART_BYTES:
            raise ValueError(f"{name} is too large")
        return self.zip.read(real)

    def xml(self, name: str) -> ET.Element | None:
        data = self.read(name)
        return parse(data) if data else None

    def relations(self, part: str) -> dict[str, dict[str, str]]:
        """Id to target (resolved), type and mode of a part's relationships."""
        from ..functions.kernels import combine_path

        folder, _, name = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = {}
        for r in children(root, "Relationship"):
            external = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            out[r.get("Id", "")] = {"target": target if external else combine_path(folder, target), "type": r.get("Type", "").rpartition("/")[2], "external": external}
        return out


def package(parts: dict[str, str | bytes], first: tuple[str, ...] = ()) -> bytes:
    """A zip file; parts named in first come first and uncompressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in [*first, *(n for n in parts if n not in first)]:
            data = parts[name]
            info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in first else zipfile.ZIP_DEFLATED
            z.writestr(info, data.encode() if isinstance(data, str) else data)
    return out.getvalue()


# Characters that XML can't hold.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def esc(value: str) -> str:
    return escape(_BAD.sub("", value))


def qattr(value: str) -> str:
    return quoteattr(_BAD.sub("", value))


HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
PACKAGE_NS = "http://schemas.openxmlformats.org/package/2006"
OFFICE_NS = "http://schemas.openxmlformats.org/officeDocument/2006"


def relationships(rows: list[tuple[str, str, str]] | list[tuple[str, str, str, bool]]) -> str:
    body = "".join(
        f"<Relationship Id={qattr(r[0])} Type={qattr(r[1] if '://' in r[1] else OFFICE_NS + '/relationships/' + r[1])} Target={qattr(r[2])}{' TargetMode=\"External\"' if len(r) > 3 and r[3] else ''}/>" for r in rows
    )
    return f'{HEAD}<Relationships xmlns="{PACKAGE_NS}/relationships">{body}</Relationships>'


def content_types(overrides: dict[str, str], defaults: dict[str, str] | None = None) -> str:
    known = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml", **(defaults or {})}
    body = "".join(f"<Default Extension={qattr(k)} ContentType={qattr(v)}/>" for k, v in known.items())
    body += "".join(f"<Override PartName={qattr('/' + k)} ContentType={qattr(v)}/>" for k, v in overrides.items())
    return f'{HEAD}<Types xmlns="{PACKAGE_NS}/content-types">{body}</Types>'


def core_properties(properties: dict[str, str]) -> str:
    tags = {"title": "dc:title", "author": "dc:creator", "subject": "dc:subject", "description": "dc:description", "created": "dcterms:created"}
    body = "".join(f"<{tags[k]}>{esc(v)}</{tags[k]}>" for k, v in properties.items() if k in tags and v)
    return f'{HEAD}<cp:coreProperties xmlns:cp="{PACKAGE_NS}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">{body}</cp:coreProperties>'


def read_core(pkg: Package) -> dict[str, str]:
    root = pkg.xml("docProps/core.xml")
    names = {"title": "title", "creator": "author", "subject": "subject", "description": "description", "created": "created"}
    return {names[local(e)]: e.text or "" for e in (root if root is not None else ()) if local(e) in names}
