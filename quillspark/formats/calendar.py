"""iCalendar: events and todos, read and written."""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from ..functions.kernels import fold_utf8, unfold

_PROPERTY = re.compile(r'([A-Za-z0-9-]+)((?:;[^=:;]+=(?:"[^"]*"|[^:;"]*))*):(.*)', re.DOTALL)


def unescape(value: str) -> str:
    return re.sub(r"\\([nN,;\\])", lambda m: "\n" if m[1] in "nN" else m[1], value)


def escape(value: str) -> str:
    return value.replace("\\", "\\\\").replace("\r\n", "\n").replace("\n", "\\n").replace(",", "\\,").replace(";", "\\;")


def properties(line: str) -> tuple[str, dict[str, str], str] | None:
    """Name, parameters and raw value of a content line."""
    m = _PROPERTY.fullmatch(line)
    if not m:
        return None
    params = {}
    for p in re.findall(r';([^=;]+)=("[^"]*"|[^;]*)', m[2]):
        params[p[0].upper()] = p[1].strip('"')
    return m[1].upper(), params, m[3]


def moment(value: str) -> tuple[dt.datetime | None, bool]:
    """(UTC time, whether it is a whole day). Local times are taken as UTC."""
    v = value.strip().rstrip("Zz")
    try:
        if re.fullmatch(r"[0-9]{8}", v):
            return dt.datetime.strptime(v, "%Y%m%d").replace(tzinfo=dt.UTC), True
        return dt.datetime.strptime(v[:15], "%Y%m%dT%H%M%S").replace(tzinfo=dt.UTC), False
    except ValueError:
        return None, False


_EVENT = {"UID": "uid", "SUMMARY": "summary", "DESCRIPTION": "description", "LOCATION": "location", "RRULE": "rrule", "STATUS": "status", "DURATION": "duration"}
_TIMES = {"DTSTART": "start", "DTEND": "end", "CREATED": "created", "LAST-MODIFIED": "last_modified", "DUE": "due", "COMPLETED": "completed"}
_NUMBERS = {"PERCENT-COMPLETE": "percent_complete", "PRIORITY": "priority"}
_IGNORED = {"DTSTAMP"}


def parse(text: str) -> dict:
    """calendar: name, method, events, todos (schema.EVENT, schema.TODO). Other components are skipped."""
    out = {"name": None, "method": None, "events": [], "todos": []}
    stack: list[tuple[str, dict]] = []
    for line in unfold(text):
        got = properties(line)
        if not got:
            continue
        name, params, value = got
        if name == "BEGIN":
            stack.append((value.strip().upper(), {"attendees": [], "extra": {}, "all_day": False}))
        elif name == "END":
            if stack:
                kind, item = stack.pop()
                if kind in ("VEVENT", "VTODO"):
                    out["events" if kind == "VEVENT" else "todos"].append(item)
        elif stack and stack[-1][0] == "VCALENDAR":
            if name == "X-WR-CALNAME":
                out["name"] = unescape(value)
            elif name == "METHOD":
                out["method"] = value
        elif stack and stack[-1][0] in ("VEVENT", "VTODO"):
            item = stack[-1][1]
            if name in _EVENT:
                item[_EVENT[name]] = unescape(value)
            elif name in _TIMES:
                item[_TIMES[name]], day = moment(value)
                if name == "DTSTART":
                    item["all_day"] = day
            elif name in _NUMBERS:
                item[_NUMBERS[name]] = int(value) if value.strip().isdigit() else None
            elif name == "ORGANIZER":
                item["organizer"] = re.sub("(?i)^mailto:", "", value)
            elif name == "ATTENDEE":
                item["attendees"].append(re.sub("(?i)^mailto:", "", value))
            elif name not in _IGNORED:
                item["extra"][name] = unescape(value)
    return out


def _lines(item: dict, todo: bool) -> list[str]:
    stamp = lambda v: v.astimezone(dt.UTC).strftime("%Y%m%dT%H%M%SZ") if v.tzinfo else v.strftime("%Y%m%dT%H%M%SZ")
    uid = item.get("uid") or hashlib.md5(repr(sorted((k, str(v)) for k, v in item.items())).encode()).hexdigest()
    out = ["BEGIN:VTODO" if todo else "BEGIN:VEVENT", f"UID:{escape(uid)}"]
    for name, key in _TIMES.items():
        v = item.get(key)
        if v is not None:
            whole = item.get("all_day") and name in ("DTSTART", "DTEND")
            out.append(f"{name};VALUE=DATE:{v.strftime('%Y%m%d')}" if whole else f"{name}:{stamp(v)}")
    for name, key in _EVENT.items():
        if name != "UID" and item.get(key):
            out.append(f"{name}:{item[key] if name in ('RRULE', 'DURATION') else escape(item[key])}")
    out += [f"{name}:{item[key]}" for name, key in _NUMBERS.items() if item.get(key) is not None]
    out += [f"ORGANIZER:mailto:{item['organizer']}"] if item.get("organizer") else []
    out += [f"ATTENDEE:mailto:{a}" for a in item.get("attendees") or ()]
    out += [f"{k}:{escape(v)}" for k, v in (item.get("extra") or {}).items()]
    return [*out, "END:VTODO" if todo else "END:VEVENT"]


def build(calendar: dict) -> str:
    out = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//documents//EN"]
    out += [f"METHOD:{calendar['method']}"] if calendar.get("method") else []
    out += [f"X-WR-CALNAME:{escape(calendar['name'])}"] if calendar.get("name") else []
    for e in calendar.get("events") or ():
        out += _lines(e, False)
    for t in calendar.get("todos") or ():
        out += _lines(t, True)
    out.append("END:VCALENDAR")
    return "".join("\r\n ".join(fold_utf8(line)) + "\r\n" for line in out)


def _fields(item: dict, labels: tuple, form: str) -> list[str]:
    out = []
    for key, label in labels:
        v = item.get(key)
        if v not in (None, "", []):
            v = v.strftime("%Y-%m-%d %H:%M") if isinstance(v, dt.datetime) else ", ".join(v) if isinstance(v, list) else v
            out.append(form.format(label=label, value=v))
    return out


# Fixed labels of the extracted text.
EVENT_LABELS = (("start", "开始"), ("end", "结束"), ("location", "地点"), ("description", "描述"), ("status", "状态"))
TODO_LABELS = (("due", "截止"), ("description", "描述"), ("status", "状态"))


def text(c: dict) -> str | None:
    if not c["events"] and not c["todos"]:
        return None
    out = [c["name"]] if c["name"] else []
    for item, labels, mark in [*((e, EVENT_LABELS, "") for e in c["events"]), *((t, TODO_LABELS, "[待办] ") for t in c["todos"])]:
        out += [""] if out else []
        out += [mark + item["summary"]] if item.get("summary") else []
        out += _fields(item, labels, "{label}: {value}")
    return "".join(line + "\n" for line in out)


def markdown(c: dict) -> str | None:
    if not c["events"] and not c["todos"]:
        return None
    out = [f"# {c['name']}", ""] if c["name"] else []
    for e in c["events"]:
        out += [f"## {e.get('summary') or '未命名事件'}", "", *_fields(e, (*EVENT_LABELS, ("organizer", "组织者"), ("attendees", "参与者")), "- **{label}**: {value}"), ""]
    for t in c["todos"]:
        out += [f"## [待办] {t.get('summary') or '未命名待办'}", "", *_fields(t, TODO_LABELS, "- **{label}**: {value}")]
        out += [f"- **进度**: {t['percent_complete']}%"] if t.get("percent_complete") is not None else []
        out.append("")
    return "".join(line + "\n" for line in out)
