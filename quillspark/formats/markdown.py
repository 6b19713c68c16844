"""Markdown: a subset of CommonMark with tables, strikethrough and task lists.

A document is a tree of nodes. Nodes are plain dictionaries: kind, and by kind text, children, level, info,
url, title, start, checked, aligns, rows.
"""

from __future__ import annotations

import re
from html import escape as html_escape

Node = dict

BLOCKS = ("document", "heading", "paragraph", "code_block", "quote", "bullet_list", "ordered_list", "list_item", "table", "table_row", "table_cell", "rule", "html")
INLINES = ("text", "strong", "emphasis", "strong_emphasis", "code", "strike", "link", "image", "hard_break", "soft_break", "autolink", "html_inline")

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_BULLET = re.compile(r"( {0,3})([-*+])(?:[ \t]+(.*)|$)")
_NUMBER = re.compile(r"( {0,3})([0-9]{1,9})([.)])(?:[ \t]+(.*)|$)")
_DIVIDER = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = re.compile(r" {0,3}<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s|/?>|$)|!--|\?|!\[CDATA\[|![A-Z])")
_TASK = re.compile(r"\[([ xX])\][ \t]+")


def node(kind: str, **values) -> Node:
    return {"kind": kind, **values}


def parse(text: str) -> Node:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", "    ").split("\n")
    return node("document", children=_blocks(lines, 0))


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    parts, cell, i = [], "", 0
    while i < len(line):
        if line[i] == "\\" and line[i + 1 : i + 2] == "|":
            cell, i = cell + "|", i + 2
        elif line[i] == "|":
            parts.append(cell)
            cell, i = "", i + 1
        else:
            cell, i = cell + line[i], i + 1
    return [c.strip() for c in ([*parts, cell] if cell.strip() or not parts else parts)]


def _starts_block(line: str) -> bool:
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or re.match(r" {0,3}>", line) or _BULLET.match(line) or re.match(r" {0,3}1[.)][ \t]", line))


def _blocks(lines: list[str], depth: int) -> list[Node]:
    out, i = [], 0
    if depth > 50:
        return [node("paragraph", children=inline("\n".join(lines)))]
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            mark, info, body, i = m[1], m[2].strip(), [], i + 1
            while i < len(lines) and not re.fullmatch(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*", lines[i]):
                body.append(lines[i])
                i += 1
            out.append(node("code_block", info=info, text="\n".join(body)))
            i += 1
        elif line.startswith("    "):
            body = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            while body and not body[-1].strip():
                body.pop()
            out.append(node("code_block", info="", text="\n".join(body)))
        elif m := _HEADING.match(line):
            out.append(node("heading", level=len(m[1]), children=inline((m[2] or "").strip())))
            i += 1
        elif _RULE.match(line):
            out.append(node("rule"))
            i += 1
        elif re.match(r" {0,3}>", line):
            body = []
            while i < len(lines) and lines[i].strip() and (re.match(r" {0,3}>", lines[i]) or not _starts_block(lines[i])):
                body.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(node("quote", children=_blocks(body, depth + 1)))
        elif _BULLET.match(line) or _NUMBER.match(line):
            item, i = _list(lines, i, depth)
            out.append(item)
        elif i + 1 < len(lines) and "|" in line and _DIVIDER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            item, i = _table(lines, i)
            out.append(item)
        elif _HTML.match(line):
            body = []
            while i < len(lines) and lines[i].strip():
                body.append(lines[i])
                i += 1
            out.append(node("html", text="\n".join(body)))
        else:
            body = [line.strip() if not line.endswith("  ") else line.lstrip()]
            i += 1
            level = 0
            while i < len(lines) and lines[i].strip():
                if m := re.fullmatch(r" {0,3}(=+|-+)[ \t]*", lines[i]):
                    level, i = (1 if m[1][0] == "=" else 2), i + 1
                    break
                if _starts_block(lines[i]) or _HTML.match(lines[i]):
                    break
                body.append(lines[i].lstrip())
                i += 1
            content = inline("\n".join(body).rstrip())
            out.append(node("heading", level=level, children=content) if level else node("paragraph", children=content))
    return out


def _list(lines: list[str], i: int, depth: int) -> tuple[Node, int]:
    m = _BULLET.match(lines[i])
    ordered = m is None
    m = m or _NUMBER.match(lines[i])
    mark = m[3] if ordered else m[2]
    items: list[Node] = []
    out = node("ordered_list" if ordered else "bullet_list", children=items, **({"start": int(m[2])} if ordered else {}))
    while i < len(lines):
        m = (_NUMBER if ordered else _BULLET).match(lines[i])
        if not m or (m[3] if ordered else m[2]) != mark or _RULE.match(lines[i]):
            break
        rest = m[4] if ordered else m[3]
        indent = len(m[1]) + len(m[2]) + (1 if ordered else 0) + 1
        if rest is not None:
            indent = max(indent, min(len(lines[i]) - len(rest), indent + 3))
        body, i = [rest or ""], i + 1
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                following = next((x for x in lines[i + 1 :] if x.strip()), None)
                if following is None or not following.startswith(" " * indent):
                    break
                body.append("")
            elif line.startswith(" " * indent):
                body.append(line[indent:])
            elif line[:1] == " " and len(line) - len(line.lstrip()) >= 2 and (_BULLET.match(line.lstrip()) or _NUMBER.match(line.lstrip())):
                body.append(line.lstrip())
            elif _starts_block(line) or not body[-1].strip():
                break
            else:
                body.append(line.lstrip())
            i += 1
        item = node("list_item")
        if t := _TASK.match(body[0]):
            item["checked"] = t[1] != " "
            body[0] = body[0][t.end() :]
        item["children"] = _blocks(body, depth + 1)
        items.append(item)
        # a blank line between two items of the same list
        j = i
        while j < len(lines) and not lines[j].strip():
            j += 1
        nxt = (_NUMBER if ordered else _BULLET).match(lines[j]) if j < len(lines) else None
        i = j if nxt and (nxt[3] if ordered else nxt[2]) == mark else i
    return out, i


def _table(lines: list[str], i: int) -> tuple[Node, int]:
    header = _cells(lines[i])
    aligns = [("center" if c.startswith(":") and c.endswith(":") else "right" if c.endswith(":") else "left" if c.startswith(":") else "") for c in _cells(lines[i + 1])]
    rows, i = [header], i + 2
    while i < len(lines) and lines[i].strip() and "|" in lines[i]:
        cells = _cells(lines[i])
        rows.append((cells + [""] * len(header))[: len(header)])
        i += 1
    return node("table", aligns=aligns, children=[node("table_row", header=k == 0, children=[node("table_cell", children=inline(c)) for c in r]) for k, r in enumerate(rows)]), i


_INLINE = re.compile(
    r"\\(?P<escaped>[!-/:-@\[-`{-~])|(?P<ticks>`+)(?P<code>.+?)(?<!`)(?P=ticks)(?!`)|(?P<image>!)?\[(?P<label>(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\((?P<url><[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?P<title>\"[^\"]*\"|'[^']*'))?\s*\)"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>@]+\.[^\s<>@]+)>|(?P<tag></?[A-Za-z][^<>]*>|<!--.*?-->)"
    r"|(?P<triple>\*\*\*|___)(?=\S)(?P<t3>.+?)(?<=\S)(?P=triple)|(?P<double>\*\*|__)(?=\S)(?P<t2>.+?[*_]?)(?<=\S)(?P=double)|~~(?=\S)(?P<strike>.+?)(?<=\S)~~"
    r"|(?P<single>\*)(?=[^\s*])(?P<t1>(?:[^*]|\*\*[^*]+\*\*)+?)(?<=\S)\*(?!\*)|(?<![A-Za-z0-9_])_(?=[^\s_])(?P<u1>[^_]+?)(?<=\S)_(?![A-Za-z0-9_])|(?P<hard> {2,}\n|\\\n)|(?P<soft>\n)",
    re.DOTALL,
)


def inline(text: str, depth: int = 0) -> list[Node]:
    out: list[Node] = []

    def plain(s: str) -> None:
        if s:
            if out and out[-1]["kind"] == "text":
                out[-1]["text"] += s
            else:
                out.append(node("text", text=s))

    end = 0
    for m in _INLINE.finditer(text) if depth < 20 else ():
        plain(text[end : m.start()])
        end = m.end()
        g = m.groupdict()
        if g["escaped"] is not None:
            plain(g["escaped"])
        elif g["code"] is not None:
            c = g["code"].replace("\n", " ")
            out.append(node("code", text=c[1:-1] if len(c) > 2 and c[0] == c[-1] == " " and c.strip() else c))
        elif g["label"] is not None:
            url, title = (g["url"] or "").strip("<>"), (g["title"] or "  ")[1:-1].strip() or None
            out.append(node("image", url=url, title=title, text=g["label"]) if g["image"] else node("link", url=url, title=title, children=inline(g["label"], depth + 1)))
        elif g["auto"] is not None:
            out.append(node("autolink", url=("mailto:" if "@" in g["auto"] and ":" not in g["auto"] else "") + g["auto"], text=g["auto"]))
        elif g["tag"] is not None:
            out.append(node("html_inline", text=g["tag"]))
        elif g["hard"] is not None or g["soft"] is not None:
            out.append(node("hard_break" if g["hard"] is not None else "soft_break"))
        else:
            kind, body = next((k, g[n]) for k, n in (("strong_emphasis", "t3"), ("strong", "t2"), ("strike", "strike"), ("emphasis", "t1"), ("emphasis", "u1")) if g[n] is not None)
            out.append(node(kind, children=inline(body, depth + 1)))
    plain(text[end:])
    return out


def plain(n: Node) -> str:
    """A node's text without markup."""
    kind = n["kind"]
    if kind in ("text", "code", "autolink", "image"):
        return n["text"]
    if kind in ("soft_break", "hard_break"):
        return "\n"
    if kind in ("html", "html_inline", "rule"):
        return ""
    if kind == "code_block":
        return n["text"]
    if kind == "table_row":
        return "".join(plain(c) + "\t" for c in n["children"])
    sep = "\n" if kind in ("document", "quote", "bullet_list", "ordered_list", "list_item", "table") else ""
    return sep.join(p for p in map(plain, n.get("children", ())) if p or kind != "document")


def text(doc: Node) -> str:
    return "".join(p + "\n" for p in map(plain, doc["children"]) if p)


_MARK = {"strong": "**", "emphasis": "*", "strong_emphasis": "***", "strike": "~~"}


def _inline_md(nodes: list[Node]) -> str:
    out = []
    for n in nodes:
        kind = n["kind"]
        if kind == "text":
            out.append(re.sub(r"([\\`*_\[\]<>])", r"\\\1", n["text"]))
        elif kind == "code":
            ticks = "`" * (max([0, *(len(t) for t in re.findall("`+", n["text"]))]) + 1)
            pad = " " if "`" in n["text"] else ""
            out.append(ticks + pad + n["text"] + pad + ticks)
        elif kind in _MARK:
            out.append(_MARK[kind] + _inline_md(n["children"]) + _MARK[kind])
        elif kind in ("link", "image"):
            label = n["text"] if kind == "image" else _inline_md(n["children"])
            title = f' "{n["title"]}"' if n.get("title") else ""
            out.append(f"{'!' if kind == 'image' else ''}[{label}]({n['url']}{title})")
        elif kind == "autolink":
            out.append(f"<{n['text']}>")
        else:
            out.append({"hard_break": "  \n", "soft_break": "\n"}.get(kind, n.get("text", "")))
    return "".join(out)


def markdown(n: Node) -> str:
    """A tree as Markdown; parsing it gives the tree again."""
    kind = n["kind"]
    kids = n.get("children", [])
    if kind == "document":
        return "\n\n".join(map(markdown, kids)) + ("\n" if kids else "")
    if kind == "heading":
        return "#" * n["level"] + " " + _inline_md(kids)
    if kind == "paragraph":
        return _inline_md(kids)
    if kind == "code_block":
        ticks = "`" * max(3, max([0, *(len(t) + 1 for t in re.findall("`{3,}", n["text"]))]))
        return f"{ticks}{n['info']}\n{n['text']}\n{ticks}"
    if kind == "quote":
        return "\n".join(f"> {line}".rstrip() for line in "\n\n".join(map(markdown, kids)).split("\n"))
    if kind in ("bullet_list", "ordered_list"):
        out = []
        for k, item in enumerate(kids):
            mark = f"{n.get('start', 1) + k}. " if kind == "ordered_list" else "- "
            task = f"[{'x' if item['checked'] else ' '}] " if "checked" in item else ""
            body = "\n".join(map(markdown, item["children"])) if all(c["kind"] in ("paragraph", "bullet_list", "ordered_list") for c in item["children"]) else "\n\n".join(map(markdown, item["children"]))
            out.append(mark + task + body.replace("\n", "\n" + " " * len(mark)))
        return re.sub(r"\n +\n", "\n\n", "\n".join(out))
    if kind == "table":
        marks = {"": "---", "left": ":---", "right": "---:", "center": ":---:"}
        lines = ["| " + " | ".join(_inline_md(c["children"]).replace("|", "\\|") for c in r["children"]) + " |" for r in kids]
        return "\n".join([lines[0], "| " + " | ".join(marks[a] for a in n["aligns"]) + " |", *lines[1:]])
    return "---" if kind == "rule" else n.get("text", "")


_UNSAFE = re.compile(r"\s*(javascript|vbscript|data):", re.IGNORECASE)


def slug(title: str) -> str:
    return re.sub(r"[^\w-]", "", re.sub(r"\s+", "-", title.strip().lower()))


def html(n: Node, safe_links: bool = True) -> str:
    """A tree as HTML; links to scripts and data go unless asked for."""
    kind = n["kind"]
    kids = "".join(html(c, safe_links) for c in n.get("children", ()))
    url = lambda: "" if safe_links and _UNSAFE.match(n["url"]) else html_escape(n["url"])
    title = f' title="{html_escape(n["title"])}"' if n.get("title") else ""
    if kind == "heading":
        return f'<h{n["level"]} id="{html_escape(slug(plain(n)))}">{kids}</h{n["level"]}>\n'
    if kind == "paragraph":
        return f"<p>{kids}</p>\n"
    if kind == "code_block":
        cls = f' class="language-{html_escape(n["info"].split()[0])}"' if n["info"] else ""
        return f"<pre><code{cls}>{html_escape(n['text'], quote=False)}\n</code></pre>\n"
    if kind == "quote":
        return f"<blockquote>\n{kids}</blockquote>\n"
    if kind == "bullet_list":
        return f"<ul>\n{kids}</ul>\n"
    if kind == "ordered_list":
        return f"<ol{f' start="{n["start"]}"' if n['start'] != 1 else ''}>\n{kids}</ol>\n"
    if kind == "list_item":
        inner = n["children"]
        body = "".join(html(c, safe_links) if c["kind"] != "paragraph" else "".join(html(x, safe_links) for x in c["children"]) for c in inner) if len([c for c in inner if c["kind"] == "paragraph"]) == 1 else kids
        box = f'<input type="checkbox" disabled{" checked" if n["checked"] else ""}> ' if "checked" in n else ""
        return f"<li>{box}{body.rstrip()}</li>\n"
    if kind == "table":
        out = []
        for r in n["children"]:
            tag = "th" if r["header"] else "td"
            cells = "".join(f'<{tag}{f" style=\"text-align:{a}\"" if a else ""}>{"".join(html(x, safe_links) for x in c["children"])}</{tag}>' for c, a in zip(r["children"], n["aligns"], strict=True))
            out.append(f"<tr>{cells}</tr>\n")
        return f"<table>\n<thead>\n{out[0]}</thead>\n<tbody>\n{''.join(out[1:])}</tbody>\n</table>\n"
    if kind == "link":
        return f'<a href="{url()}"{title}>{kids}</a>'
    if kind == "autolink":
        return f'<a href="{url()}">{html_escape(n["text"])}</a>'
    if kind == "image":
        return f'<img src="{url()}" alt="{html_escape(n["text"])}"{title}>'
    tags = {"strong": ("<strong>", "</strong>"), "emphasis": ("<em>", "</em>"), "strong_emphasis": ("<strong><em>", "</em></strong>"), "strike": ("<del>", "</del>")}
    if kind in tags:
        return tags[kind][0] + kids + tags[kind][1]
    if kind == "code":
        return f"<code>{html_escape(n['text'], quote=False)}</code>"
    if kind == "text":
        return html_escape(n["text"], quote=False)
    return {"rule": "<hr>\n", "hard_break": "<br>\n", "soft_break": "\n", "html": n.get("text", "") + "\n", "html_inline": n.get("text", "")}.get(kind, kids)


def html_page(doc: Node, title: str = "", style: str = "") -> str:
    css = f"<style>{style}</style>" if style else ""
    return f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{html_escape(title)}</title>\n{css}</head>\n<body>\n{html(doc)}</body>\n</html>\n'


def flat(doc: Node) -> list[dict]:
    """The tree in pre-order: node_id, parent_id, depth, ord, kind, text, level, url."""
    out: list[dict] = []

    def walk(n: Node, parent: int | None, depth: int, order: int) -> None:
        me = len(out)
        own = n["text"] if "text" in n else plain(n) if n["kind"] in ("heading", "paragraph", "table_cell") else None
        out.append({"node_id": me, "parent_id": parent, "depth": depth, "ord": order, "kind": n["kind"], "text": own, "level": n.get("level"), "url": n.get("url"), "info": n.get("info")})
        for k, c in enumerate(n.get("children", ())):
            walk(c, me, depth + 1, k)

    walk(doc, None, 0, 0)
    return out


# Factories of trees.
def heading(level: int, content: str) -> Node:
    return node("heading", level=max(1, min(6, level)), children=inline(content))


def paragraph(content: str) -> Node:
    return node("paragraph", children=inline(content))


def paragraph_of(*inlines: Node | str) -> Node:
    """A paragraph of inline nodes; a string is text as it stands."""
    return node("paragraph", children=_nodes(inlines))


def _nodes(inlines) -> list[Node]:
    return [literal(i) if isinstance(i, str) else i for i in inlines]


def literal(content: str) -> Node:
    """Text as it stands, whatever marks it holds."""
    return node("text", text=content)


def strong(*inlines: Node | str) -> Node:
    return node("strong", children=_nodes(inlines))


def emphasis(*inlines: Node | str) -> Node:
    return node("emphasis", children=_nodes(inlines))


def strong_emphasis(*inlines: Node | str) -> Node:
    return node("strong_emphasis", children=_nodes(inlines))


def strike(*inlines: Node | str) -> Node:
    return node("strike", children=_nodes(inlines))


def code(content: str) -> Node:
    return node("code", text=content)


def link(label: str | Node, url: str, title: str | None = None) -> Node:
    return node("link", url=url, title=title, children=_nodes([label]))


def image(alt: str, url: str, title: str | None = None) -> Node:
    return node("image", url=url, title=title, text=alt)


def line_break(hard: bool = True) -> Node:
    return node("hard_break" if hard else "soft_break")


def html_inline(content: str) -> Node:
    return node("html_inline", text=content)


def code_block(content: str, info: str = "") -> Node:
    return node("code_block", info=info, text=content)


def quote(*blocks: Node) -> Node:
    return node("quote", children=list(blocks))


def list_item(*blocks: Node, checked: bool | None = None) -> Node:
    return node("list_item", children=list(blocks), **({} if checked is None else {"checked": checked}))


def bullet_list(items: list[str]) -> Node:
    return node("bullet_list", children=[list_item(paragraph(i)) for i in items])


def ordered_list(items: list[str], start: int = 1) -> Node:
    return node("ordered_list", start=start, children=[list_item(paragraph(i)) for i in items])


def rule() -> Node:
    return node("rule")


def html_block(content: str) -> Node:
    return node("html", text=content)


def table(rows: list[list[str]], aligns: list[str] | None = None) -> Node:
    return node("table", aligns=aligns or [""] * len(rows[0]), children=[node("table_row", header=k == 0, children=[node("table_cell", children=inline(c)) for c in r]) for k, r in enumerate(rows)])


def document(*blocks: Node) -> Node:
    return node("document", children=list(blocks))
