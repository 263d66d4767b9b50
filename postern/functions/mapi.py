"""Message properties of compound files: property tables, typed values, recipients and attachments."""

from __future__ import annotations

import codecs
import struct
from datetime import datetime, timedelta

from postern.functions import rtf
from postern.functions.compound import Compound

TABLE = "__properties_version1.0"
#: Property types, code pages whose codec has another name, and the properties that results name.
UNICODE, STRING8, BINARY, OBJECT, I16, I32, BOOL, I64, TIME, REAL = 0x1F, 0x1E, 0x102, 0x0D, 2, 3, 0x0B, 0x14, 0x40, 5
CODEPAGES = {65001: "utf-8", 20127: "ascii", 28591: "latin-1", 28605: "iso8859-15", 50220: "iso2022-jp", 51949: "euc-kr", 54936: "gb18030", 20866: "koi8-r"}
SUBJECT, CLASS, BODY, HTML, RTF, SENT, MESSAGE_ID, NAME, ADDRESS, ROLE = 0x37, 0x1A, 0x1000, 0x1013, 0x1009, 0x39, 0x1035, 0x3001, 0x3003, 0xC15
ATTACH_DATA, ATTACH_NAME, ATTACH_SHORT, ATTACH_MIME, ATTACH_CID, ATTACH_METHOD, SMTP = 0x3701, 0x3707, 0x3704, 0x370E, 0x3712, 0x3705, 0x39FE
INTERNET_PAGE, MESSAGE_PAGE, TRANSPORT, ATTACH_FLAGS, ATTACH_HIDDEN, REFERENCED = 0x3FDE, 0x3FFD, 0x7D, 0x3714, 0x7FFE, 4
ROLES = {1: "to", 2: "cc", 3: "bcc"}
#: The tags that a reader of messages knows, and where tags begin whose meaning a file itself defines.
KNOWN = frozenset((SUBJECT, CLASS, BODY, HTML, RTF, SENT, NAME, ROLE, SMTP, ATTACH_DATA, ATTACH_NAME, ATTACH_SHORT, ATTACH_MIME, ATTACH_CID, ATTACH_METHOD, INTERNET_PAGE, MESSAGE_PAGE, TRANSPORT, ATTACH_FLAGS, ATTACH_HIDDEN, 0x0E06, 0x3007, 0x3008, 0x0C1A, 0x0C1E, 0x0C1F, 0x5D01, 0x3002, ADDRESS, 0x3703))
NAMED, EMBEDDED = range(0x8000, 0xFFFF), 5


def stream_name(tag: int, kind: int) -> str:
    return f"__substg1.0_{tag:04X}{kind:04X}"


def utc_of(ticks: int) -> str | None:
    """A count of 100 ns since 1601 as RFC 3339 text; None past year 9999."""
    try:
        return (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%S+00:00") if ticks >= 0 else None
    except OverflowError:
        return None


def text8(data: bytes, pages: list[int]) -> tuple[str, str]:
    """(text, how) of 8-bit text: the declared pages, then ASCII, UTF-8 and windows-1252."""
    for page in pages:
        name = CODEPAGES.get(page, f"cp{page}")
        try:
            return data.decode(codecs.lookup(name).name), f"cp{page}"
        except (LookupError, UnicodeDecodeError):
            continue
    for name in ("ascii", "utf-8"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("cp1252", "replace"), "cp1252"


def properties(file: Compound, storage: str = "", header: int = 32, pages: list[int] | None = None) -> list[dict]:
    """Rows (tag, type, value as text, data, how, fault) of one storage's property table."""
    prefix = f"{storage}/" if storage else ""
    table = file.get(prefix + TABLE)
    if table is None:
        return []
    entries = [struct.unpack_from("<HHI8s", table, at) for at in range(header, len(table) - 15, 16)]
    if pages is None:
        numbers = {tag: struct.unpack("<i", v[:4])[0] for kind, tag, _, v in entries if kind == I32}
        pages = [numbers[t] for t in (INTERNET_PAGE, MESSAGE_PAGE) if t in numbers]
    out = []
    for kind, tag, _, value in entries:
        row = {"tag": tag, "type": kind, "value": None, "data": None, "how": None, "ladder": False, "fault": None}
        if kind in (UNICODE, STRING8, BINARY):
            data = file.get(f"{prefix}__substg1.0_{tag:04X}{kind:04X}")
            if data is None:
                row["fault"] = "no_stream"
            elif kind == BINARY:
                row["data"] = data
            elif kind == UNICODE:
                try:
                    row |= {"value": data.decode("utf-16-le").rstrip("\0"), "how": "utf-16"}
                except UnicodeDecodeError:
                    row |= {"data": data, "fault": "bad_utf16"}
            else:
                row["value"], row["how"] = text8(data.rstrip(b"\0"), pages)
                row["ladder"] = row["how"] not in [f"cp{page}" for page in pages]
        elif kind in (I16, I32, BOOL, I64, TIME, REAL):
            number = struct.unpack({I16: "<h6x", I32: "<i4x", BOOL: "<H6x", I64: "<q", TIME: "<q", REAL: "<d"}[kind], value)[0]
            row["value"] = utc_of(number) if kind == TIME else str(bool(number)).lower() if kind == BOOL else str(number)
        elif kind != OBJECT:
            row["fault"] = "unknown_type"
        out.append(row)
    return out


def _children(file: Compound, prefix: str, below: str = "") -> list[str]:
    """Storages named ``prefix`` and a number, directly below ``below``, in file order."""
    start = f"{below}/{prefix}".lower() if below else prefix.lower()
    return [e.path for e in file.entries if e.kind == 1 and e.path.lower().startswith(start) and "/" not in e.path[len(start) :]]


def _number(path: str) -> int | None:
    try:
        return int(path.rpartition("#")[2], 16)
    except ValueError:
        return None


def embedded_summary(file: Compound, storage: str) -> dict | None:
    """What an attached message says of itself, one level deep: a message attached to it is named, not read."""
    inner = next((e.path for e in file.entries if e.kind == 1 and e.path.lower() == f"{storage}/{stream_name(ATTACH_DATA, OBJECT)}".lower()), None)
    if inner is None:
        return None
    rows = {p["tag"]: p for p in reversed(properties(file, inner, 24))}
    value = lambda tag: rows[tag]["value"] if tag in rows else None
    files = _children(file, "__attach_version1.0_#", inner)
    nested = next((_number(path) for path in files if any(p["tag"] == ATTACH_METHOD and p["value"] == str(EMBEDDED) for p in properties(file, path, 8, []))), None)
    return {"message_class": value(CLASS), "subject": value(SUBJECT), "has_transport": TRANSPORT in rows, "n_recipients": len(_children(file, "__recip_version1.0_#", inner)), "n_attachments": len(files), "nested": nested}


def observations(file: Compound, top: list[dict], recipients: list[tuple[str, list[dict]]], attached: list[dict]) -> list[tuple[str, str]]:
    """(gap, detail) of a message's properties: tags without a known meaning, named ones, text that no declared page decodes, recipients that disagree with their count."""
    both = [*top, *[p for _, rows in recipients for p in rows]]
    named = sorted({f"{p['tag']:04x}" for p in both if p["tag"] in NAMED})
    unknown = sorted({f"{p['tag']:04x}:{p['type']:04x}" for p in [*both, *attached] if p["tag"] not in KNOWN and p["tag"] not in NAMED})
    table = file.get(TABLE) or b""
    declared = struct.unpack_from("<I", table, 16)[0] if len(table) >= 20 else None
    unreadable = next((path for path, rows in recipients if _number(path) is None or file.get(f"{path}/{TABLE}") is None), None)
    disagree = f"declared={declared} rows={len(recipients)}" if declared is not None and declared != len(recipients) else unreadable
    found = [("msg.property_tag_unknown", ",".join(unknown) or None), ("msg.named_property_unresolved", ",".join(named) or None), ("msg.codepage_unresolved_ladder_used", "" if any(p["ladder"] for p in both) else None), ("msg.recipient_table_unreadable", disagree)]
    return [(gap, detail) for gap, detail in found if detail is not None]


def message(file: Compound) -> dict:
    """Properties, recipients, attachments and bodies of a message; other classes of items are refused by ``refused``."""
    props = properties(file)
    by_tag = {p["tag"]: p for p in reversed(props)}
    text = lambda rows, *tags: next((rows[t]["value"] for t in tags if t in rows and rows[t]["value"] is not None), None)
    kind = text(by_tag, CLASS)
    refused = None if props and (kind or "").lower().startswith("ipm.note") else "no_properties" if not props else "not_a_mail_class"
    pages = [int(by_tag[t]["value"]) for t in (INTERNET_PAGE, MESSAGE_PAGE) if t in by_tag and by_tag[t]["value"]]
    out = {"message_class": kind, "refused": refused, "properties": props, "recipients": [], "attachments": [], "subject": text(by_tag, SUBJECT), "sent": text(by_tag, SENT), "message_id": text(by_tag, MESSAGE_ID), "body": text(by_tag, BODY), "html": None, "rtf": None, "rtf_fault": None, "html_data": None, "html_how": None, "transport": text(by_tag, TRANSPORT)}
    for name, tag in (("body", BODY), ("transport", TRANSPORT), ("html", HTML)):
        out[f"{name}_stream"] = stream_name(tag, by_tag[tag]["type"]) if tag in by_tag else None
        if name != "html":
            out[f"{name}_data"] = file.get(out[f"{name}_stream"]) if tag in by_tag else None
    if refused:
        return out
    if HTML in by_tag and by_tag[HTML]["data"] is not None:
        out["html_data"] = by_tag[HTML]["data"]
        out["html"], out["html_how"] = text8(by_tag[HTML]["data"], pages)
    if RTF in by_tag and by_tag[RTF]["data"] is not None:
        out["rtf"], out["rtf_fault"] = rtf.expand(by_tag[RTF]["data"])
    people: list[tuple[str, list[dict]]] = []
    attached: list[dict] = []
    out["embedded"] = []
    for e in file.entries:
        if "/" in e.path or e.kind != 1:
            continue
        low = e.path.lower()
        if low.startswith(("__recip_version1.0_#", "__attach_version1.0_#")):
            own = properties(file, e.path, 8, pages)
            rows = {p["tag"]: p for p in reversed(own)}
            if low.startswith("__recip"):
                people.append((e.path, own))
                out["recipients"].append({"role": ROLES.get(int(text(rows, ROLE) or 0), "unknown"), "name": text(rows, NAME), "address": text(rows, SMTP, ADDRESS)})
            else:
                attached += own
                if text(rows, ATTACH_METHOD) == str(EMBEDDED) and (summary := embedded_summary(file, e.path)):
                    out["embedded"].append({"ordinal": len(out["attachments"])} | summary)
                data = rows[ATTACH_DATA]["data"] if ATTACH_DATA in rows else None
                embedded = any(x.path.lower() == f"{low}/__substg1.0_3701000d" for x in file.entries)
                filename = next((rows[t]["value"] for t in (ATTACH_NAME, ATTACH_SHORT, NAME) if t in rows and rows[t]["value"]), None)
                flags = int(text(rows, ATTACH_FLAGS) or 0)
                more = {"inline": bool(flags & REFERENCED), "hidden": text(rows, ATTACH_HIDDEN) == "true", "stream": f"{e.path}/{stream_name(ATTACH_DATA, BINARY)}"}
                out["attachments"].append(more | {"filename": filename, "mime": text(rows, ATTACH_MIME), "content_id": text(rows, ATTACH_CID), "method": text(rows, ATTACH_METHOD), "embedded": embedded, "data": data})
    out["observations"] = observations(file, props, people, attached)
    return out


def render(subject: str, body: str | None, recipients: list[tuple[int, str, str]], attachments: list[tuple], sent: int, rich: bytes | None = None, html: bytes | None = None, transport: str | None = None, extra: list[tuple[int, int, object]] | None = None) -> dict:
    """The storages of a message, for compound.write(). Attachments: name, media type, data (a tree as this makes: an embedded message; None: one that is missing), and a content id if it is inline. ``extra``: more properties."""

    def storage(header: bytes, values: list[tuple[int, int, object]]) -> dict:
        tree, table = {}, bytearray(header)
        for tag, kind, v in values:
            if kind in (UNICODE, STRING8, BINARY):
                data = v.encode("utf-16-le") if kind == UNICODE else v
                tree[f"__substg1.0_{tag:04X}{kind:04X}"] = data
                cell = struct.pack("<II", len(data) + 2 * (kind == UNICODE), 0)
            else:
                cell = struct.pack("<q", v)
            table += struct.pack("<HHI", kind, tag, 6) + cell
        return tree | {TABLE: bytes(table)}

    head = bytes(8) + struct.pack("<4I", len(recipients), len(attachments), len(recipients), len(attachments)) + bytes(8)
    more = [(BODY, UNICODE, body), (RTF, BINARY, rich), (HTML, BINARY, html), (TRANSPORT, UNICODE, transport)]
    top = [(CLASS, UNICODE, "IPM.Note"), (SUBJECT, UNICODE, subject), (SENT, TIME, sent), *[p for p in more if p[2] is not None], *(extra or [])]
    tree = storage(head, top)
    for k, (role, name, address) in enumerate(recipients):
        tree[f"__recip_version1.0_#{k:08X}"] = storage(bytes(8), [(ROLE, I32, role), (NAME, UNICODE, name), (SMTP, UNICODE, address)])
    for k, (name, mime, data, *cid) in enumerate(attachments):
        inline = [(ATTACH_CID, UNICODE, cid[0]), (ATTACH_FLAGS, I32, REFERENCED)] if cid else []
        held = [(ATTACH_METHOD, I32, 1), (ATTACH_DATA, BINARY, data)] if isinstance(data, bytes) else [(ATTACH_METHOD, I32, EMBEDDED)]
        tree[f"__attach_version1.0_#{k:08X}"] = storage(bytes(8), [(ATTACH_NAME, UNICODE, name), *([(ATTACH_MIME, UNICODE, mime)] if mime else []), *held, *inline])
        if isinstance(data, dict):  # the tree of a message; its property table's header is shorter than a top one
            inner = data | {TABLE: data[TABLE][:24] + data[TABLE][32:]}
            tree[f"__attach_version1.0_#{k:08X}"][stream_name(ATTACH_DATA, OBJECT)] = inner
    return tree
