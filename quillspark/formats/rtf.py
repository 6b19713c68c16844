"""Rich text: paragraphs, tables, images and document information, read and written."""

from __future__ import annotations

import re

from ..functions.kernels import md_table

_TOKEN = re.compile(rb"\\([a-zA-Z]{1,32})(-?[0-9]{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
# Destinations whose text isn't the document's.
_SKIPPED = frozenset("fonttbl colortbl stylesheet listtable listoverridetable rsidtbl generator themedata colorschememapping datastore latentstyles header footer headerl headerr footerl footerr fldinst xmlnstbl mmathPr pgptbl".split())
_INFO = {"title": "title", "author": "author", "subject": "subject", "keywords": "keywords", "doccomm": "comment", "company": "company"}
_CHARS = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " "}
_CODEPAGES = {"0": "cp1252", "128": "cp932", "129": "cp949", "134": "gbk", "136": "big5", "161": "cp1253", "162": "cp1254", "204": "cp1251", "238": "cp1250"}


def parse(data: bytes) -> dict:
    """info, blocks (paragraphs with runs; tables with rows of cell texts) and images. Not RTF: no blocks."""
    out = {"info": {}, "blocks": [], "images": []}
    if not data.lstrip().startswith(b"{\\rtf"):
        return out
    state = {"skip": False, "dest": None, "uc": 1, "b": False, "i": False, "ul": False, "strike": False, "hidden": False, "size": 24, "font": 0, "align": "left", "intbl": False}
    stack: list[dict] = []
    codepage, fonts = "cp1252", {}
    runs: list[dict] = []
    rows, cells, cell = [], [], []
    picture = bytearray()
    pending, after = b"", 0

    def emit(s: str) -> None:
        if not s or state["skip"] or state["hidden"]:
            return
        if state["dest"] in _INFO:
            out["info"][_INFO[state["dest"]]] = out["info"].get(_INFO[state["dest"]], "") + s
            return
        if state["dest"] is not None:
            return
        style = {k: state[k] for k in ("b", "i", "ul", "strike", "size")}
        if runs and runs[-1]["style"] == style:
            runs[-1]["text"] += s
        else:
            runs.append({"text": s, "style": style})

    def flush() -> None:
        nonlocal pending
        if pending:
            emit(pending.decode(fonts.get(state["font"], codepage), "replace"))
            pending = b""

    def end_table() -> None:
        nonlocal rows
        if rows:
            out["blocks"].append({"kind": "table", "rows": rows})
            rows = []

    def end_paragraph() -> None:
        nonlocal runs
        if state["intbl"]:
            cell.append({"runs": runs})
        else:
            end_table()
            out["blocks"].append({"kind": "paragraph", "runs": runs, "align": state["align"]})
        runs = []

    font = None
    for m in _TOKEN.finditer(data):
        word, number, hexa, symbol, brace, text = m.groups()
        if hexa is not None:
            if after:
                after -= 1
            elif state["dest"] == "fonttbl":
                pass
            else:
                pending += bytes.fromhex(hexa.decode())
            continue
        if text is not None and after and state["dest"] != "pict":
            n = min(after, len(text))
            after, text = after - n, text[n:]
        if text is not None and not (state["dest"] == "pict" or state["dest"] == "fonttbl"):
            flush()
            emit(text.decode("latin-1") if text.isascii() else text.decode(codepage, "replace"))
            continue
        flush()
        if brace == b"{":
            stack.append(dict(state))
        elif brace == b"}":
            if state["dest"] == "pict" and stack and stack[-1]["dest"] != "pict":
                if picture:
                    out["images"].append(bytes(picture))
                picture = bytearray()
            if stack:
                state = stack.pop()
            after = 0
        elif text is not None and state["dest"] == "pict":
            digits = re.sub(rb"[^0-9a-fA-F]", b"", text)
            picture += bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        elif symbol is not None:
            if symbol == b"*":
                state["skip"] = True
            elif symbol in (b"\\", b"{", b"}"):
                emit(symbol.decode())
            elif symbol == b"~":
                emit("\u00a0")
            elif symbol == b"_":
                emit("-")
            elif symbol in (b"\n", b"\r"):
                end_paragraph()
        elif word is not None:
            w, n = word.decode(), int(number) if number else None
            if w == "u" and n is not None:
                emit(chr(n % 65536) if not 0xD800 <= n % 65536 <= 0xDFFF else "")
                if 0xD800 <= n % 65536 <= 0xDBFF:
                    state["high"] = n % 65536
                elif 0xDC00 <= n % 65536 <= 0xDFFF and state.get("high"):
                    emit(chr(0x10000 + ((state.pop("high") - 0xD800) << 10) + n % 65536 - 0xDC00))
                after = state["uc"]
                continue
            if w == "uc":
                state["uc"] = n or 0
            elif w == "pict":
                state["dest"], state["skip"] = "pict", True
            elif w in _SKIPPED:
                state["dest"], state["skip"] = w, True
            elif w == "info":
                state["dest"] = "info"
            elif state["dest"] == "info" and w in _INFO:
                state["dest"] = w
            elif state["dest"] == "fonttbl":
                if w == "f":
                    font = n
                elif w == "fcharset" and font is not None:
                    fonts[font] = _CODEPAGES.get(str(n), "cp1252")
            elif w == "ansicpg" and n:
                codepage = f"cp{n}" if n != 936 else "gbk"
                try:
                    b"".decode(codepage)
                except LookupError:
                    codepage = "cp1252"
            elif w in ("b", "i", "ul", "strike"):
                state[w] = n != 0
            elif w == "ulnone":
                state["ul"] = False
            elif w == "v":
                state["hidden"] = n != 0
            elif w == "fs":
                state["size"] = n or 24
            elif w == "f":
                state["font"] = n or 0
            elif w == "plain":
                state |= {"b": False, "i": False, "ul": False, "strike": False, "hidden": False, "size": 24}
            elif w in ("ql", "qr", "qc", "qj"):
                state["align"] = {"ql": "left", "qr": "right", "qc": "center", "qj": "justify"}[w]
            elif w == "pard":
                state |= {"align": "left", "intbl": False}
            elif w == "intbl":
                state["intbl"] = True
            elif w == "trowd":
                cells, cell = [], []
            elif state["skip"]:
                pass
            elif w == "par":
                end_paragraph()
            elif w == "cell":
                cells.append([*cell, {"runs": runs}] if runs or not cell else cell)
                runs, cell = [], []
            elif w == "row":
                rows.append(cells)
                cells, state["intbl"] = [], False
            elif w in ("sect", "page"):
                end_paragraph()
            elif w in _CHARS:
                emit(_CHARS[w])
    flush()
    if runs:
        state["intbl"] = False
        end_paragraph()
    end_table()
    return out


def paragraph_text(p: dict) -> str:
    return "".join(r["text"] for r in p["runs"])


def cell_text(cell: list[dict]) -> str:
    return " ".join(paragraph_text(p) for p in cell)


def tables(doc: dict) -> list[list[list[str]]]:
    return [[[cell_text(c) for c in r] for r in b["rows"]] for b in doc["blocks"] if b["kind"] == "table"]


def text(doc: dict) -> str:
    out = []
    for b in doc["blocks"]:
        out += [paragraph_text(b)] if b["kind"] == "paragraph" else ["\t".join(cell_text(c) for c in r) for r in b["rows"]]
    return "".join(line + "\n" for line in out)


def markdown(doc: dict) -> str:
    out: list[str] = []
    for b in doc["blocks"]:
        out += [paragraph_text(b), ""] if b["kind"] == "paragraph" else [*md_table([[cell_text(c) for c in r] for r in b["rows"]]), ""]
    return "".join(line + "\n" for line in out)


def escape(s: str) -> str:
    out = []
    for c in s:
        n = ord(c)
        if c in "\\{}":
            out.append("\\" + c)
        elif c == "\n":
            out.append("\\line ")
        elif c == "\t":
            out.append("\\tab ")
        elif n < 128:
            out.append(c)
        elif n < 65536:
            out.append(f"\\u{n if n < 32768 else n - 65536}?")
        else:
            n -= 0x10000
            out.append("".join(f"\\u{u - 65536}?" for u in (0xD800 + (n >> 10), 0xDC00 + (n & 0x3FF))))
    return "".join(out)


def build(blocks: list[dict], info: dict[str, str] | None = None, images: list[bytes] = ()) -> bytes:
    """Blocks: paragraphs (text or runs, align) and tables (rows of texts). Images are PNG data."""
    tags = {v: k for k, v in _INFO.items()}
    head = "".join(f"{{\\{tags[k]} {escape(v)}}}" for k, v in (info or {}).items() if k in tags and v)
    body = []
    for b in blocks:
        if b["kind"] == "paragraph":
            align = {"right": "\\qr", "center": "\\qc", "justify": "\\qj"}.get(b.get("align", ""), "\\ql")
            parts = []
            for r in b.get("runs") or [{"text": b.get("text", ""), "style": {}}]:
                s = r.get("style") or {}
                on = "".join(f"\\{k}" for k in ("b", "i", "ul", "strike") if s.get(k)) + (f"\\fs{s['size']}" if s.get("size") else "")
                parts.append(f"{{{on} {escape(r['text'])}}}" if on else escape(r["text"]))
            body.append(f"\\pard{align} {''.join(parts)}\\par\n")
        else:
            width = max((len(r) for r in b["rows"]), default=0)
            edges = "".join(f"\\cellx{9000 * (i + 1) // max(1, width)}" for i in range(width))
            for r in b["rows"]:
                cells = "".join(f"\\pard\\intbl {escape(c or '')}\\cell" for c in [*r, *[""] * (width - len(r))])
                body.append(f"\\trowd{edges}{cells}\\row\n")
    body += [f"\\pard{{\\pict\\pngblip {i.hex()}}}\\par\n" for i in images]
    return ("{\\rtf1\\ansi\\ansicpg1252\\deff0{\\fonttbl{\\f0 Times New Roman;}}" + (f"{{\\info{head}}}" if head else "") + "\n" + "".join(body) + "}").encode("ascii")


def fill(data: bytes, values: dict[str, str]) -> bytes:
    """{{Name}} replaced by escaped values; unknown names stay. Braces stand escaped in the file."""
    one = lambda m: escape(values[m[1].decode()]).encode() if m[1].decode() in values else m[0]
    return re.sub(rb"\\\{\\\{(\w+)\\\}\\\}|\{\{(\w+)\}\}", lambda m: one(m) if m[1] else (escape(values[m[2].decode()]).encode() if m[2].decode() in values else m[0]), data)
