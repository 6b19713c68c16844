"""Stored mail messages (MAPI properties in a compound file)."""

from __future__ import annotations

import datetime as dt
import struct

from . import cfb, mail

# Property ids.
SUBJECT, BODY, HTML, HEADERS = 0x0037, 0x1000, 0x1013, 0x007D
SENDER_NAME, SENDER_MAIL, SENDER_SMTP = 0x0C1A, 0x0C1F, 0x5D01
DISPLAY_TO, DISPLAY_CC, DISPLAY_BCC, MESSAGE_ID = 0x0E04, 0x0E03, 0x0E02, 0x1035
NAME, ADDRESS, SMTP, KIND = 0x3001, 0x3003, 0x39FE, 0x0C15
FILE, LONG_FILE, DATA, MIME, CONTENT_ID = 0x3704, 0x3707, 0x3701, 0x370E, 0x3712
SENT, DELIVERED = 0x0039, 0x0E06


class _Properties:
    def __init__(self, storage: cfb.Storage, head: int):
        self.storage, self.fixed = storage, {}
        raw = storage.stream("__properties_version1.0") or b""
        for i in range(head, len(raw) - 15, 16):
            tag, value = struct.unpack_from("<I4x8s", raw, i)
            self.fixed[tag >> 16] = value

    def text(self, tag: int) -> str | None:
        wide = self.storage.stream(f"__substg1.0_{tag:04X}001F")
        if wide is not None:
            return wide.decode("utf-16-le", "replace").rstrip("\0")
        narrow = self.storage.stream(f"__substg1.0_{tag:04X}001E")
        return narrow.decode("utf-8", "replace").rstrip("\0") if narrow is not None else None

    def data(self, tag: int) -> bytes | None:
        return self.storage.stream(f"__substg1.0_{tag:04X}0102")

    def number(self, tag: int) -> int | None:
        return struct.unpack_from("<i", self.fixed[tag])[0] if tag in self.fixed else None

    def time(self, tag: int) -> dt.datetime | None:
        if tag not in self.fixed:
            return None
        ticks = struct.unpack("<Q", self.fixed[tag])[0]
        return dt.datetime(1601, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=ticks // 10) if 0 < ticks < 1 << 62 else None


def _mailbox(name: str | None, address: str | None) -> str | None:
    return f"{name} <{address}>" if name and address and name != address else address or name


def _list(text: str | None) -> list[str]:
    return [p.strip() for p in (text or "").replace(",", ";").split(";") if p.strip("\0 ")]


def parse(data: bytes) -> dict:
    """The message struct of mail.parse. Recipients by their kind; the display fields where there are none."""
    root = cfb.parse(data)
    p = _Properties(root, 32)
    html = p.text(HTML)
    if html is None and p.data(HTML) is not None:
        html = p.data(HTML).decode("utf-8", "replace")
    out = {
        "from": _mailbox(p.text(SENDER_NAME), p.text(SENDER_SMTP) or p.text(SENDER_MAIL)), "to": [], "cc": [], "bcc": [], "subject": p.text(SUBJECT), "date": p.time(SENT) or p.time(DELIVERED), "date_offset_min": None,
        "message_id": p.text(MESSAGE_ID), "reply_to": None, "text_body": p.text(BODY), "html_body": html, "attachments": [], "inline_images": {}, "headers": {},
    }
    for name, c in sorted(root.children.items()):
        if not isinstance(c, cfb.Storage):
            continue
        q = _Properties(c, 8)
        if name.startswith("__recip_version1.0_"):
            who = _mailbox(q.text(NAME), q.text(SMTP) or q.text(ADDRESS))
            if who:
                out[{2: "cc", 3: "bcc"}.get(q.number(KIND) or 1, "to")].append(who)
        elif name.startswith("__attach_version1.0_"):
            item = {"file_name": q.text(LONG_FILE) or q.text(FILE), "content_type": q.text(MIME), "content_id": q.text(CONTENT_ID), "data": q.data(DATA)}
            out["attachments"].append(item)
    for key, tag in (("to", DISPLAY_TO), ("cc", DISPLAY_CC), ("bcc", DISPLAY_BCC)):
        out[key] = out[key] or _list(p.text(tag))
    return out


text, markdown = mail.text, mail.markdown
