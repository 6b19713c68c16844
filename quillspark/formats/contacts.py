"""vCard contacts, read and written."""

from __future__ import annotations

import datetime as dt
import re

from ..functions.kernels import fold_utf8, from_base64, quoted_printable, unfold
from .calendar import escape, properties, unescape

NAME = ("family", "given", "additional", "prefix", "suffix")
ADDRESS = ("po_box", "extended", "street", "city", "region", "postal_code", "country")
_TEXT = {"FN": "full_name", "ORG": "organization", "TITLE": "title", "NOTE": "note", "URL": "url", "UID": "uid"}


def _split(value: str, parts: int) -> list[str | None]:
    """At semicolons that no backslash guards; then each part is unescaped."""
    got = [unescape(p) or None for p in re.split(r"(?<!\\)(?:\\\\)*;", value)]
    return (got + [None] * parts)[:parts]


def _date(value: str) -> dt.date | None:
    v = value.strip()[:10].replace("-", "")[:8]
    try:
        return dt.datetime.strptime(v, "%Y%m%d").date()
    except ValueError:
        return None


def _moment(value: str) -> dt.datetime | None:
    v = re.sub("[-:]", "", value.strip()).rstrip("Zz")
    for form in ("%Y%m%dT%H%M%S", "%Y%m%d"):
        try:
            return dt.datetime.strptime(v, form).replace(tzinfo=dt.UTC)
        except ValueError:
            continue
    return None


def _kind(params: dict[str, str], bare: str) -> str | None:
    kinds = params.get("TYPE") or ",".join(p for p in bare.split(";") if p and "=" not in p)
    return kinds or None


def parse(text: str) -> list[dict]:
    """All VCARD blocks: see schema.CONTACT."""
    out, item = [], None
    for line in unfold(text):
        head, _, value = line.partition(":")
        bare = ";".join(p for p in head.split(";")[1:] if "=" not in p)
        plain = ";".join([head.split(";")[0], *(p for p in head.split(";")[1:] if "=" in p)])
        got = properties(f"{plain}:{value}")
        if not got:
            continue
        name, params, value = got
        name = name.rpartition(".")[2]
        if name == "BEGIN" and value.strip().upper() == "VCARD":
            item = {"full_name": None, "name": None, "phones": [], "emails": [], "addresses": [], "extra": {}}
        elif item is None:
            continue
        elif name == "END":
            out.append(item)
            item = None
        else:
            if params.get("ENCODING", "").upper().startswith("QUOTED") or "QUOTED-PRINTABLE" in bare.upper():
                value = quoted_printable(value.encode()).decode(params.get("CHARSET", "utf-8"), "replace")
            if name in _TEXT:
                item[_TEXT[name]] = unescape(value)
            elif name == "N":
                item["name"] = dict(zip(NAME, _split(value, 5), strict=True))
            elif name == "TEL":
                item["phones"].append({"number": unescape(value), "type": _kind(params, bare)})
            elif name == "EMAIL":
                item["emails"].append({"address": unescape(value), "type": _kind(params, bare)})
            elif name == "ADR":
                item["addresses"].append({**dict(zip(ADDRESS, _split(value, 7), strict=True)), "type": _kind(params, bare)})
            elif name == "BDAY":
                item["birthday"] = _date(value)
            elif name == "REV":
                item["revision"] = _moment(value)
            elif name == "PHOTO":
                item["photo"] = value if params.get("ENCODING", "B").upper().startswith("B") and from_base64(value) is not None else unescape(value)
            elif name != "VERSION":
                item["extra"][name] = unescape(value)
    return out


def build(contacts: list[dict]) -> str:
    lines: list[str] = []
    kind = lambda v: f";TYPE={v['type']}" if v.get("type") else ""
    for c in contacts:
        lines += ["BEGIN:VCARD", "VERSION:3.0"]
        lines += [f"{k}:{escape(c[f])}" for k, f in _TEXT.items() if c.get(f)]
        if c.get("name"):
            lines.append("N:" + ";".join(escape(c["name"].get(p) or "") for p in NAME))
        lines += [f"TEL{kind(p)}:{escape(p['number'] or '')}" for p in c.get("phones") or ()]
        lines += [f"EMAIL{kind(e)}:{escape(e['address'] or '')}" for e in c.get("emails") or ()]
        lines += [f"ADR{kind(a)}:" + ";".join(escape(a.get(p) or "") for p in ADDRESS) for a in c.get("addresses") or ()]
        lines += [f"BDAY:{c['birthday'].isoformat()}"] if c.get("birthday") else []
        lines += [f"REV:{c['revision'].strftime('%Y%m%dT%H%M%SZ')}"] if c.get("revision") else []
        lines += [f"PHOTO;ENCODING=B:{c['photo']}"] if c.get("photo") else []
        lines += [f"{k}:{escape(v)}" for k, v in (c.get("extra") or {}).items()]
        lines.append("END:VCARD")
    return "".join("\r\n ".join(fold_utf8(line)) + "\r\n" for line in lines)


def _lines(c: dict, form: str) -> list[str]:
    kind = lambda v: f" ({v['type']})" if v.get("type") else ""
    # Fixed labels of the extracted text.
    rows = [("组织", c.get("organization")), ("职位", c.get("title")), ("生日", c["birthday"].isoformat() if c.get("birthday") else None)]
    rows += [("电话", (p["number"] or "") + kind(p)) for p in c["phones"]]
    rows += [("邮箱", (e["address"] or "") + kind(e)) for e in c["emails"]]
    order = ("country", "region", "city", "street", "postal_code")
    rows += [("地址", " ".join(a[p] for p in order if a.get(p)) + kind(a)) for a in c["addresses"] if any(a.get(p) for p in order)]
    rows += [("网址", c.get("url")), ("备注", c.get("note"))]
    return [form.format(label=k, value=v) for k, v in rows if v]


def text(contacts: list[dict]) -> str | None:
    if not contacts:
        return None
    out: list[str] = []
    for i, c in enumerate(contacts):
        out += ([""] if i else []) + ([c["full_name"]] if c.get("full_name") else []) + _lines(c, "{label}: {value}")
    return "".join(line + "\n" for line in out)


def markdown(contacts: list[dict]) -> str | None:
    if not contacts:
        return None
    out: list[str] = []
    for c in contacts:
        out += [f"## {c.get('full_name') or '未命名联系人'}", "", *_lines(c, "- **{label}**: {value}"), ""]
    return "".join(line + "\n" for line in out)
