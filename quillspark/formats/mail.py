"""Mail messages: RFC 5322 with MIME, read and written."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import email.utils
import re

from ..functions.kernels import from_base64, quoted_printable, strip_html

_WORD = re.compile(r"=\?([^?]+)\?([bBqQ])\?([^?]*)\?=")


def decode_header(value: str) -> str:
    """RFC 2047 words decoded; white space between two of them goes."""

    def one(m: re.Match) -> str:
        try:
            data = base64.b64decode(m[3] + "=" * (-len(m[3]) % 4)) if m[2] in "bB" else binascii.a2b_qp(m[3].replace("_", " "), header=True)
            return data.decode(m[1].partition("*")[0], "replace")
        except (LookupError, ValueError):
            return m[0]

    return _WORD.sub(one, re.sub(r"(\?=)\s+(=\?)", r"\1\2", value))


def addresses(value: str | None) -> list[str]:
    """Split at commas outside quotes."""
    parts = re.split(r',(?=(?:[^"]*"[^"]*")*[^"]*$)', value or "")
    return [p.strip() for p in parts if p.strip()]


def _header_block(text: str) -> tuple[list[tuple[str, str]], str]:
    """Unfolded header fields and the body after the first empty line."""
    m = re.search(r"\r?\n\r?\n", text)
    head, body = (text[: m.start()], text[m.end() :]) if m else (text, "")
    if text.startswith(("\n", "\r\n")):
        head, body = "", text.lstrip("\r\n")
    fields: list[tuple[str, str]] = []
    for line in re.split(r"\r\n|\n|\r", head):
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip().lower(), value.strip()))
    return fields, body


def parameters(value: str) -> tuple[str, dict[str, str]]:
    """A structured field's value and its parameters."""
    main, *rest = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', value)
    out = {}
    for p in rest:
        k, _, v = p.partition("=")
        out[k.strip().lower()] = decode_header(v.strip().strip('"'))
    return main.strip().lower(), out


def _content(body: str, encoding: str) -> bytes:
    raw = body.encode("utf-8", "surrogateescape")
    if encoding == "base64":
        data = from_base64(body)
        return raw if data is None else data
    return quoted_printable(raw) if encoding == "quoted-printable" else raw


def _text(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def parse(data: bytes) -> dict:
    """A message: see schema.MAIL. Of repeated headers the last one counts, but addresses of all To, Cc and Bcc."""
    fields, body = _header_block(data.decode("utf-8", "surrogateescape"))
    head = dict(fields)
    every = lambda n: [a for k, v in fields if k == n for a in addresses(decode_header(v))]
    when = None
    try:
        when = email.utils.parsedate_to_datetime(head["date"])
    except (KeyError, TypeError, ValueError, IndexError):
        pass
    offset = when.utcoffset() if when is not None and when.tzinfo else None
    out = {
        "from": decode_header(head["from"]) if "from" in head else None, "to": every("to"), "cc": every("cc"), "bcc": every("bcc"),
        "subject": decode_header(head["subject"]) if "subject" in head else None,
        "date": when.replace(tzinfo=when.tzinfo or dt.UTC).astimezone(dt.UTC) if when else None, "date_offset_min": int(offset.total_seconds() // 60) if offset is not None else (0 if when else None),
        "message_id": head.get("message-id"), "reply_to": decode_header(head["reply-to"]) if "reply-to" in head else None,
        "text_body": None, "html_body": None, "attachments": [], "inline_images": {}, "headers": {k: decode_header(v.encode("utf-8", "surrogateescape").decode("utf-8", "replace")) for k, v in head.items()},
    }
    _part(head, body, out, 0)
    return out


def _part(head: dict[str, str], body: str, out: dict, depth: int) -> None:
    kind, params = parameters(head.get("content-type", "text/plain"))
    if kind.startswith("multipart/") and params.get("boundary") and depth < 32:
        for part in re.split(rf"(?:^|\r?\n)--{re.escape(params['boundary'])}(?:--)?[ \t]*(?=\r?\n|$)", body)[1:]:
            part = re.sub(r"^\r?\n", "", part, count=1)
            if part.strip():
                fields, inner = _header_block(part)
                _part(dict(fields), inner, out, depth + 1)
        return
    data = _content(body, head.get("content-transfer-encoding", "").strip().lower())
    place, more = parameters(head.get("content-disposition", ""))
    name = more.get("filename") or params.get("name")
    cid = head.get("content-id", "").strip("<> ")
    if place == "attachment" or name or not kind.startswith("text/"):
        item = {"file_name": name, "content_type": kind, "content_id": cid or None, "data": data}
        if cid and kind.startswith("image/") and place != "attachment":
            out["inline_images"][cid] = item
        else:
            out["attachments"].append(item)
    elif kind == "text/html":
        out["html_body"] = out["html_body"] or _text(data, params.get("charset"))
    else:
        out["text_body"] = out["text_body"] or _text(data, params.get("charset"))


# Fixed labels of the extracted text.
LABELS = (("from", "发件人"), ("to", "收件人"), ("cc", "抄送"), ("subject", "主题"), ("date", "日期"))


def _rendered(m: dict, form: str) -> str:
    lines = []
    for key, label in LABELS:
        v = m.get(key)
        if v:
            if key == "date":
                v = (v + dt.timedelta(minutes=m.get("date_offset_min") or 0)).strftime("%Y-%m-%d %H:%M:%S")
            lines.append(form.format(label=label, value=", ".join(v) if isinstance(v, list) else v))
    body = m.get("text_body") or (strip_html(m["html_body"]) if m.get("html_body") else "")
    return "".join(line + "\n" for line in [*lines, ""]) + body


def text(m: dict) -> str:
    return _rendered(m, "{label}: {value}")


def markdown(m: dict) -> str:
    return _rendered(m, "- **{label}**: {value}")


def _encoded(value: str) -> str:
    """A header's text; other than ASCII as base64 words of whole characters."""
    if value.isascii():
        return value
    parts, chunk = [], ""
    for c in value:
        if len((chunk + c).encode()) > 42:
            parts.append(chunk)
            chunk = ""
        chunk += c
    return "\r\n ".join(f"=?utf-8?B?{base64.b64encode(p.encode()).decode()}?=" for p in [*parts, chunk])


def _address(value: str) -> str:
    m = re.fullmatch(r"\s*(.*?)\s*<([^<>]+)>\s*", value)
    if not m or not m[1]:
        return value.strip()
    name = m[1].strip('"')
    return f'"{name}" <{m[2]}>' if name.isascii() and re.search(r"[,;:@]", name) else f"{_encoded(name)} <{m[2]}>"


def _body(text_: str, kind: str) -> str:
    data = binascii.b2a_qp(text_.replace("\r\n", "\n").encode(), istext=True).decode().replace("\r\n", "\n").replace("\n", "\r\n")
    return f"Content-Type: {kind}; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n{data}"


def _file(item: dict, inline: bool) -> str:
    lines = base64.encodebytes(item.get("data") or b"").decode().replace("\n", "\r\n")
    name = _encoded(item.get("file_name") or "file").replace("\r\n ", " ")
    head = f'Content-Type: {item.get("content_type") or "application/octet-stream"}; name="{name}"\r\nContent-Transfer-Encoding: base64\r\n'
    head += f'Content-Disposition: {"inline" if inline else "attachment"}; filename="{name}"\r\n'
    if item.get("content_id"):
        head += f"Content-ID: <{item['content_id']}>\r\n"
    return head + "\r\n" + lines


def build(m: dict) -> bytes:
    """The message as MIME text. Bcc is never written; all addressees of To stand in one header."""
    out = []
    for key, name in (("from", "From"), ("reply_to", "Reply-To")):
        if m.get(key):
            out.append(f"{name}: {_address(m[key])}")
    for key, name in (("to", "To"), ("cc", "Cc")):
        if m.get(key):
            out.append(f"{name}: " + ",\r\n ".join(map(_address, m[key])))
    if m.get("subject") is not None:
        out.append(f"Subject: {_encoded(m['subject'])}")
    if m.get("date"):
        zone = dt.timezone(dt.timedelta(minutes=m.get("date_offset_min") or 0))
        when = m["date"] if m["date"].tzinfo else m["date"].replace(tzinfo=dt.UTC)
        out.append(f"Date: {email.utils.format_datetime(when.astimezone(zone))}")
    if m.get("message_id"):
        out.append(f"Message-ID: {m['message_id']}")
    out.append("MIME-Version: 1.0")
    bodies = [_body(m["text_body"] or "", "text/plain")] if m.get("text_body") is not None or not m.get("html_body") else []
    bodies += [_body(m["html_body"], "text/html")] if m.get("html_body") else []
    level = 0

    def multipart(kind: str, parts: list[str]) -> str:
        nonlocal level
        level += 1
        mark = f"=_part_{level}_{abs(hash_of(parts)):x}"
        return f'Content-Type: multipart/{kind}; boundary="{mark}"\r\n\r\n' + "".join(f"--{mark}\r\n{p}\r\n" for p in parts) + f"--{mark}--\r\n"

    whole = multipart("alternative", bodies) if len(bodies) > 1 else bodies[0]
    if m.get("inline_images"):
        whole = multipart("related", [whole, *(_file({**i, "content_id": k}, True) for k, i in m["inline_images"].items())])
    if m.get("attachments"):
        whole = multipart("mixed", [whole, *(_file(a, False) for a in m["attachments"])])
    return ("\r\n".join(out) + "\r\n" + whole).encode("utf-8", "surrogateescape")


def hash_of(parts: list[str]) -> int:
    """The same for the same parts, so that output is reproducible."""
    return binascii.crc32("\0".join(parts).encode("utf-8", "surrogateescape"))
