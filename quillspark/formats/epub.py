"""EPUB books: metadata and chapters, read and written."""

from __future__ import annotations

import re
from urllib.parse import unquote

from ..functions.kernels import combine_path, extract_title, strip_html
from .xml import HEAD, Package, esc, every, find, local, package, qattr, text as inner

_META = ("title", "creator", "language", "identifier", "publisher", "description", "date")


def parse(data: bytes) -> dict:
    """Metadata and chapters in the order of the spine; entries without a file are dropped."""
    pkg = Package(data)
    root_file = every(pkg.xml("META-INF/container.xml"), "rootfile")
    path = root_file[0].get("full-path", "") if root_file else ""
    opf = pkg.xml(path) if path else None
    out = {k: None for k in _META} | {"chapters": []}
    if opf is None:
        return out
    for e in every(opf, "metadata")[0] if every(opf, "metadata") else ():
        if local(e) in _META and out[local(e)] is None:
            out[local(e)] = inner(e).strip()
    folder = path.rpartition("/")[0]
    manifest = {e.get("id"): combine_path(folder, unquote(e.get("href", ""))) for e in every(find(opf, "manifest"), "item")}
    for ref in every(find(opf, "spine"), "itemref"):
        name = manifest.get(ref.get("idref"))
        html = pkg.read(name) if name else None
        if html is not None:
            content = html.decode("utf-8", "replace")
            out["chapters"].append({"title": extract_title(content) or f"Chapter {len(out['chapters']) + 1}", "content": content, "file_name": name})
    return out


def text(book: dict) -> str | None:
    if not book["chapters"]:
        return None
    return "".join(f"{c['title']}\n{strip_html(c['content'])}\n\n" for c in book["chapters"])


def markdown(book: dict) -> str | None:
    if not book["chapters"]:
        return None
    return "".join(f"# {c['title']}\n\n{strip_html(c['content'])}\n\n" for c in book["chapters"])


def build(book: dict) -> bytes:
    """EPUB 3 with one file a chapter and a table of contents."""
    chapters = book.get("chapters") or []
    files = [f"chapter{i + 1}.xhtml" for i in range(len(chapters))]
    page = lambda title, body: f'{HEAD}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{esc(title)}</title></head><body>{body}</body></html>'
    parts: dict[str, str | bytes] = {"mimetype": "application/epub+zip"}
    parts["META-INF/container.xml"] = f'{HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    for f, c in zip(files, chapters, strict=True):
        body = c.get("content") or ""
        parts[f"OEBPS/{f}"] = body if "<html" in body else page(c.get("title") or "", body if re.search(r"</?[A-Za-z]", body) else f"<p>{esc(body)}</p>")
    nav = "".join(f"<li><a href={qattr(f)}>{esc(c.get('title') or '')}</a></li>" for f, c in zip(files, chapters, strict=True))
    parts["OEBPS/nav.xhtml"] = page("Contents", f'<nav epub:type="toc"><ol>{nav}</ol></nav>')
    meta = "".join(f"<dc:{k}>{esc(book[k])}</dc:{k}>" for k in _META if book.get(k) and k != "identifier")
    items = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' + "".join(f'<item id="c{i}" href={qattr(f)} media-type="application/xhtml+xml"/>' for i, f in enumerate(files))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(files)))
    ident = esc(book.get("identifier") or "book")
    parts["OEBPS/content.opf"] = (
        f'{HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{ident}</dc:identifier>{meta}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    )
    return package(parts, ("mimetype",))
