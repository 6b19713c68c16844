"""Documents and decks laid out as PDF."""

from __future__ import annotations

from . import docx, pptx
from .pdf import Flow

# Font sizes of body text and headings, and of a deck's pages.
BODY, HEADINGS = 11, {1: 22, 2: 18, 3: 15, 4: 13, 5: 11, 6: 11}
SLIDE_TITLE, SLIDE_BODY, BAR = 18, 14, (0.0, 48 / 255, 135 / 255)


def docx_to_pdf(data: bytes) -> bytes:
    """Paragraphs and tables in order; headings larger, with a gap before. Empty paragraphs go."""
    out = Flow()

    def block(b: dict) -> None:
        if b["kind"] == "control":
            for x in b["blocks"]:
                block(x)
        elif b["kind"] == "table":
            out.gap(4).table([["\n".join(map(docx.plain, c["blocks"])).replace("\n", " ") for c in r] for r in b["rows"]])
            out.gap(4)
        elif b["text"]:
            if b["page_break"] and out.pages:
                out.page()
            if b["level"]:
                out.gap(8)
            bold = bool(b["level"]) or all(r["bold"] for r in b["runs"] if r["text"])
            out.text(b["text"], HEADINGS.get(b["level"], BODY), bold)

    for b in docx.Document(data).blocks():
        block(b)
    return out.save()


def _texts(shapes: list[dict]) -> list[dict]:
    return [x for s in shapes for x in ([s] if s["text"].strip() else _texts(s["children"]))]


def pptx_to_pdf(data: bytes, title: str | None = None, author: str | None = None, numbered: bool = False) -> bytes:
    """A page across for each slide: the uppermost text is its title, on a bar, other texts follow from the top, those
    that repeat the title go; then its tables. A slide without texts is named by its number."""
    out = Flow(842, 595, 40, numbered=numbered)
    out.info = {k: v for k, v in (("title", title), ("author", author)) if v}
    deck = pptx.Deck(data)
    for k in range(len(deck.slides)):
        shapes = deck.shapes(k)
        texts = [s["text"].strip() for s in sorted(_texts(shapes), key=lambda s: s["top"])]
        head = texts[0] if texts else f"幻灯片 {k + 1}"
        out.page().rect(out.margin, out.margin, out.width - 2 * out.margin, 44, BAR)
        out._ops().append(b"1 g")
        out.draw(head.replace("\n", " "), out.margin + 8, out.margin + 32, SLIDE_TITLE)
        out._ops().append(b"0 g")
        out.gap(56)
        for t in texts[1:]:
            if t != head:
                out.text(t, SLIDE_BODY)
        for s in shapes:
            if s["rows"]:
                out.gap(4).table([[c.replace("\n", " ") for c in r] for r in s["rows"]])
    return out.save()
