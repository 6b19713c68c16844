"""XPS documents: pages, glyph runs, properties and images, read and written."""

from __future__ import annotations

from ..functions.kernels import combine_path
from .xml import HEAD, Package, content_types, core_properties, every, package, qattr, read_core, relationships

_IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".wdp", ".bmp", ".gif")


def _pages(pkg: Package) -> list[str]:
    start = [r["target"] for r in pkg.relations("").values() if r["type"] == "fixedrepresentation"] or ["FixedDocumentSequence.fdseq"]
    out = []
    for doc in every(pkg.xml(start[0]), "DocumentReference"):
        path = combine_path(start[0].rpartition("/")[0], doc.get("Source", ""))
        out += [combine_path(path.rpartition("/")[0], p.get("Source", "")) for p in every(pkg.xml(path), "PageContent")]
    return out or sorted(n for n in pkg.names if n.lower().endswith(".fpage"))


def parse(data: bytes) -> dict:
    """properties, and pages with text, size and glyph runs (text, x, y, font_size)."""
    pkg = Package(data)
    pages = []
    for path in _pages(pkg):
        root = pkg.xml(path)
        if root is None:
            continue
        glyphs = []
        for g in every(root, "Glyphs"):
            number = lambda k, g=g: float(g.get(k) or 0)
            glyphs.append({"text": g.get("UnicodeString", "").removeprefix("{}"), "x": number("OriginX"), "y": number("OriginY"), "font_size": number("FontRenderingEmSize")})
        pages.append({"text": "".join(g["text"] + "\n" for g in glyphs if g["text"]), "width": float(root.get("Width") or 0), "height": float(root.get("Height") or 0), "glyphs": glyphs})
    return {"properties": read_core(pkg), "pages": pages}


def images(data: bytes) -> list[tuple[str, bytes]]:
    pkg = Package(data)
    return [(n, pkg.read(n) or b"") for n in pkg.names if n.lower().endswith(_IMAGES)]


def text(doc: dict) -> str | None:
    return "\n".join(p["text"] for p in doc["pages"]) if doc["pages"] else None


def markdown(doc: dict) -> str | None:
    return "\n---\n\n".join(p["text"] for p in doc["pages"]) if doc["pages"] else None


def build(pages: list[list[str]], properties: dict[str, str] | None = None, pictures: list[bytes] = (), width: float = 816, height: float = 1056, size: float = 14) -> bytes:
    """One page for each list of lines; pictures are stored beside them."""
    ns = 'xmlns="http://schemas.microsoft.com/xps/2005/06"'
    parts: dict[str, str | bytes] = {}
    parts["[Content_Types].xml"] = content_types({}, {"fdseq": "application/vnd.ms-package.xps-fixeddocumentsequence+xml", "fdoc": "application/vnd.ms-package.xps-fixeddocument+xml", "fpage": "application/vnd.ms-package.xps-fixedpage+xml", "png": "image/png"})
    parts["_rels/.rels"] = relationships([("r1", "http://schemas.microsoft.com/xps/2005/06/fixedrepresentation", "/FixedDocumentSequence.fdseq"), ("r2", "http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties", "/docProps/core.xml")])
    parts["docProps/core.xml"] = core_properties(properties or {})
    parts["FixedDocumentSequence.fdseq"] = f'{HEAD}<FixedDocumentSequence {ns}><DocumentReference Source="/Documents/1/FixedDoc.fdoc"/></FixedDocumentSequence>'
    parts["Documents/1/FixedDoc.fdoc"] = f"{HEAD}<FixedDocument {ns}>" + "".join(f'<PageContent Source="Pages/{i + 1}.fpage"/>' for i in range(len(pages))) + "</FixedDocument>"
    for i, lines in enumerate(pages):
        runs = "".join(f'<Glyphs OriginX="96" OriginY="{96 + k * size * 1.4:.2f}" FontRenderingEmSize="{size:g}" Fill="#FF000000" UnicodeString={qattr(("{}" if t.startswith("{") else "") + t)}/>' for k, t in enumerate(lines))
        parts[f"Documents/1/Pages/{i + 1}.fpage"] = f'{HEAD}<FixedPage {ns} Width="{width:g}" Height="{height:g}" xml:lang="en">{runs}</FixedPage>'
    for i, data in enumerate(pictures):
        parts[f"Resources/Images/{i + 1}.png"] = data
    return package(parts)
