"""Header-value grammars: encoded words, parameters, addresses and dates. All are total: bad input gives a state and a reason."""

from __future__ import annotations

import base64
import binascii
import codecs
import re

KINDS = {
    **dict.fromkeys("from to cc bcc reply-to sender resent-from resent-to resent-cc resent-bcc resent-sender resent-reply-to".split(), "address_list"),
    **dict.fromkeys(("date", "resent-date"), "date_time"),
    **dict.fromkeys(("message-id", "resent-message-id", "content-id"), "message_id"),
    **dict.fromkeys(("in-reply-to", "references"), "message_id_list"),
    **dict.fromkeys("received return-path authentication-results dkim-signature arc-seal arc-message-signature arc-authentication-results".split(), "unparsed"),
}
UNIQUE = frozenset("date from sender reply-to to cc bcc message-id in-reply-to references subject mime-version content-type content-transfer-encoding content-id content-description content-disposition".split())


def kind_of(name: str, status: str = "ok") -> str:
    return KINDS.get(name.lower(), "text") if status == "ok" else "unparsed"


def codec_of(charset: str) -> str | None:
    """Python's name of a text charset; a language suffix does not belong to it."""
    try:
        info = codecs.lookup(charset.partition("*")[0].strip())
    except (LookupError, ValueError):
        return None
    return info.name if info._is_text_encoding else None


# -- encoded words ---------------------------------------------------------------------------------

_WORD = re.compile(r"=\?([^?\s]*)\?([A-Za-z])\?([^?\s]*)\?=")
_BAD_Q = re.compile(r"=(?![0-9A-Fa-f]{2})")


def _word_bytes(charset: str, letter: str, body: str, size: int) -> bytes | None:
    if size > 75 or codec_of(charset) is None:
        return None
    if letter in "Qq":
        if _BAD_Q.search(body):
            return None
        return re.sub(rb"=(..)", lambda m: bytes([int(m[1], 16)]), body.replace("_", " ").encode("latin-1"))
    if letter in "Bb":
        try:
            return base64.b64decode(body.encode("latin-1"), validate=True)
        except (binascii.Error, ValueError):
            return None
    return None


def decode_words(value: str) -> tuple[str, bool, bool, bool]:
    """(text, decoded, invalid, fallback) of an unfolded latin-1 value. Neighbours of one charset join as bytes, blanks between words go."""
    value = value.replace("\r", "").replace("\n", "")
    out: list[str] = []
    state = {"decoded": False, "invalid": False, "fallback": False}
    pending: tuple[str, str, bytes] | None = None  # codec, charset, bytes
    end, after_word = 0, False

    def close() -> None:
        nonlocal pending
        if pending:
            codec, _, data = pending
            try:
                out.append(data.decode(codec))
            except (UnicodeDecodeError, LookupError, ValueError):
                out.append(data.decode("latin-1"))
                state["fallback"] = True
            state["decoded"] = True
            pending = None

    for m in _WORD.finditer(value):
        between = value[end : m.start()]
        joins = after_word and not between.strip(" \t")
        data = _word_bytes(m[1], m[2], m[3], m.end() - m.start())
        if not joins:
            close()
            out.append(between)
        if data is None:
            close()
            state["invalid"] = True
            out.append(m[0])
        elif pending and pending[0] == codec_of(m[1]):
            pending = (pending[0], pending[1], pending[2] + data)
        else:
            close()
            pending = (codec_of(m[1]), m[1], data)
        end, after_word = m.end(), True
    close()
    out.append(value[end:])
    return "".join(out), state["decoded"], state["invalid"], state["fallback"]


# -- parameters ------------------------------------------------------------------------------------

_SEGMENT = re.compile(r'(?:"(?:\\.|[^"\\])*(?:"|\\?\Z)|[^";])*', re.DOTALL)
_NAME = re.compile(r"([^*]+)(?:\*(\d+))?(\*)?\Z")
_ANY_WORD = re.compile(r"=\?[^?\r\n]*\?[^?\r\n]*\?[^?\r\n]*\?=")


def _percent(text: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("latin-1"))


def _under(charset: str, data: bytes) -> tuple[str, str, str | None]:
    try:
        if codec_of(charset):
            return data.decode(charset), "decoded", None
    except (UnicodeDecodeError, LookupError, ValueError):
        pass
    return data.decode("latin-1"), "undecodable", None


def _join(group: list[tuple[int | None, bool, str]]) -> tuple[str, str, str | None]:
    numbered = sorted(((n, star, text) for n, star, text in group if n is not None), key=lambda x: x[0])
    if numbered:
        at = [n for n, _, _ in numbered]
        if len(set(at)) < len(at):
            return "", "fallback", "duplicate_continuation_index"
        if at[-1] - at[0] + 1 != len(at):
            return "", "fallback", "missing_continuation_index"
        charset, data = "", b""
        for k, (_, star, text) in enumerate(numbered):
            if star and k == 0 and text.count("'") >= 2:
                charset, _, text = text.split("'", 2)
            data += _percent(text) if star else text.encode("latin-1")
        return _under(charset, data) if charset else (data.decode("latin-1"), "decoded", None)
    for _, _, text in (x for x in group if x[1]):
        if text.count("'") < 2:
            return text, "undecodable", None
        charset, _, rest = text.split("'", 2)
        return _under(charset, _percent(rest)) if charset else (_percent(rest).decode("latin-1"), "fallback", "empty_charset")
    text = group[0][2]
    return (text, "fallback", "encoded_word_in_parameter") if _ANY_WORD.search(text) else (text, "decoded", None)


def parameters(value: str) -> list[tuple[str, str, str, str | None]]:
    """(name, value, state, reason) of each parameter of a latin-1 value, continuations joined, in order of first mention."""
    groups: dict[str, list[tuple[int | None, bool, str]]] = {}
    at, first = 0, True
    while at <= len(value):
        m = _SEGMENT.match(value, at)
        name, eq, text = m[0].partition("=")
        at = m.end() + 1
        name, text = name.strip(), text.strip()
        if not first and eq and name:
            if len(text) > 1 and text[0] == text[-1] == '"':
                text = re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.DOTALL)
            parts = _NAME.match(name)
            base, number, star = parts.groups() if parts else (name, None, None)
            groups.setdefault(base.lower(), []).append((int(number) if number else None, bool(star), text))
        first = False
    return [(name, *_join(group)) for name, group in groups.items()]


# -- addresses -------------------------------------------------------------------------------------

_TOKEN = re.compile(r'(?P<ws>[ \t\r\n]+)|(?P<quoted>"(?:\\.|[^"\\])*")|(?P<literal>\[(?:\\.|[^\[\]\\])*\])|(?P<open>\()|(?P<mark>[<>,;:@.])|(?P<atom>[^ \t\r\n()<>@,;:\\".\[\]]+)|(?P<bad>.)', re.DOTALL)


def _tokens(text: str) -> list[tuple[str, str, int, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "open":  # comments nest
            depth, end = 1, at + 1
            while end < len(text) and depth:
                c = text[end]
                end += 2 if c == "\\" else 1
                depth += (c == "(") - (c == ")")
            kind, end = ("comment" if not depth else "bad"), min(end, len(text))
        out.append((kind, text[at:end], at, end))
        at = end
    return out


def _plain(token: tuple[str, str, int, int]) -> str:
    return re.sub(r"\\(.)", r"\1", token[1][1:-1]) if token[0] == "quoted" else token[1]


def _spec(tokens: list) -> str | None:
    """local@domain from tokens without blanks and comments."""
    words = [t for t in tokens if t[0] not in ("ws", "comment")]
    marks = [k for k, t in enumerate(words) if t[1] == "@" and t[0] == "mark"]
    if len(marks) != 1:
        return None
    local, domain = words[: marks[0]], words[marks[0] + 1 :]

    def dotted(part: list, kinds: tuple[str, ...]) -> bool:
        return bool(part) and len(part) % 2 == 1 and all((t[0] in kinds) if k % 2 == 0 else t[1] == "." for k, t in enumerate(part))

    if not dotted(local, ("atom", "quoted")) or not (dotted(domain, ("atom",)) or (len(domain) == 1 and domain[0][0] == "literal")):
        return None
    return "".join(t[1] for t in local) + "@" + "".join(t[1] for t in domain)


def _display(tokens: list) -> str | None:
    text, gap = "", False
    for t in tokens:
        if t[0] in ("ws", "comment"):
            gap = True
            continue
        text += (" " if gap and text else "") + _plain(t)
        gap = False
    return decode_words(text)[0] if text else None


def _mailbox(tokens: list) -> tuple[str | None, str | None, str] | None:
    """(display name, addr-spec, state) of one address."""
    opens = [k for k, t in enumerate(tokens) if t[1] == "<" and t[0] == "mark"]
    if not opens:
        spec = _spec(tokens)
        comment = next((t[1][1:-1] for t in tokens if t[0] == "comment"), None)
        return (comment, spec, "parsed") if spec else None
    close = next((k for k in range(len(tokens) - 1, -1, -1) if tokens[k][1] == ">" and tokens[k][0] == "mark"), None)
    if len(opens) != 1 or close is None or close < opens[0] or any(t[0] not in ("ws", "comment") for t in tokens[close + 1 :]):
        return None
    inner = tokens[opens[0] + 1 : close]
    if inner and inner[0][1] == "@":  # a source route ends at its colon
        colon = next((k for k, t in enumerate(inner) if t[1] == ":"), None)
        inner = inner[colon + 1 :] if colon is not None else []
    name = tokens[: opens[0]]
    spec = _spec(inner)
    if spec is None or any(t[0] in ("bad", "literal") or t[1] in "@:;" for t in name if t[0] == "mark" or t[0] in ("bad", "literal")):
        return None
    return _display(name), spec, "parsed"


UNPARSABLE = "headers.address_unparsable"


def addresses(value: bytes) -> list[dict]:
    """Rows (offset and length in bytes of the value, display_name, addr_spec, state, reason_id), members beside their group.

    A value of a single address is covered whole; a list's rows cover their own text. An unreadable address is kept verbatim.
    """
    try:
        text = value.decode()
    except UnicodeDecodeError:
        text = value.decode("latin-1")
    wide = text.encode() == value
    size = (lambda s: len(s.encode())) if wide else len
    tokens = _tokens(text)
    rows: list[dict] = []

    def add(part: list, group: bool) -> None:
        core = [k for k, t in enumerate(part) if t[0] != "ws"]
        if not core:
            return
        part = part[core[0] : core[-1] + 1]
        lo, hi = part[0][2], part[-1][3]
        got = _mailbox(part)
        row = {"offset": size(text[:lo]), "length": size(text[lo:hi]), "display_name": None, "addr_spec": text[lo:hi], "state": "unparsed", "reason_id": UNPARSABLE}
        if got:
            row |= {"display_name": got[0], "addr_spec": got[1], "state": got[2], "reason_id": None}
        rows.append(row | {"member": group})

    part: list = []
    group = False
    angle = False
    for t in tokens:
        mark = t[1] if t[0] == "mark" else ""
        angle = mark == "<" or (angle and mark != ">")
        if mark == ":" and not angle and not group:
            core = [x for x in part if x[0] != "ws"]
            lo = core[0][2] if core else t[2]
            rows.append({"offset": size(text[:lo]), "length": size(text[lo : t[3]]), "display_name": None, "addr_spec": None, "state": "group", "reason_id": None, "member": False, "_at": (lo, t[3])})
            group, part = True, []
        elif mark == "," and not angle:
            add(part, group)
            part = []
        elif mark == ";" and not angle:
            before = len(rows)
            add(part, group)
            part = []
            if group and len(rows) == before and rows and rows[-1].get("_at"):  # no member: the row names the group as written
                lo = rows[-1]["_at"][0]
                rows[-1] |= {"length": size(text[lo : t[3]]), "addr_spec": text[lo : t[3]]}
            group = False
        else:
            part.append(t)
    add(part, group)
    for r in rows:
        r.pop("_at", None)
    if len(rows) == 1 and rows[0]["state"] != "group":
        rows[0] |= {"offset": 0, "length": len(value)}
    return rows


# -- dates -----------------------------------------------------------------------------------------

ZONES = {"ut": "+0000", "gmt": "+0000", "est": "-0500", "edt": "-0400", "cst": "-0600", "cdt": "-0500", "mst": "-0700", "mdt": "-0600", "pst": "-0800", "pdt": "-0700"}
_MONTHS = {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_DATE = re.compile(r"(?:(?P<wd>[A-Za-z]{3})\s*,)?\s*(?P<d>\d{1,2})\s+(?P<mon>[A-Za-z]{3})\s+(?P<y>\d{2,})\s+(?P<h>\d{2})\s*:\s*(?P<m>\d{2})(?:\s*:\s*(?P<s>\d{2}))?(?:\s+(?P<z>\S+))?\s*\Z", re.ASCII)
_COMMENT = re.compile(r"\((?:\\.|[^()\\])*\)")
INVALID, NO_DATE, NO_ZONE = "headers.invalid_date", "headers.no_date", "headers.date_no_zone"


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y -= m <= 2
    era, year = divmod(y, 400)
    return era * 146097 + year * 365 + year // 4 - year // 100 + (153 * ((m + 9) % 12) + 2) // 5 + d - 719469


def civil_from_days(n: int) -> tuple[int, int, int]:
    era, day = divmod(n + 719468, 146097)
    year = (day - day // 1460 + day // 36524 - day // 146096) // 365
    left = day - (365 * year + year // 4 - year // 100)
    month = (5 * left + 2) // 153
    m = month + 3 if month < 10 else month - 9
    return year + era * 400 + (m <= 2), m, left - (153 * month + 2) // 5 + 1


def _zone(token: str) -> tuple[str, str | None, int | None]:
    """(state, offset as stated, minutes or None where they cannot be trusted)."""
    if re.fullmatch(r"[+-]\d{4}", token, re.ASCII):
        if token == "-0000":
            return "zone_stated_minus_zero", token, 0
        hours, minutes = int(token[1:3]), int(token[3:])
        return "zone_stated", token, None if minutes > 59 else (-1 if token[0] == "-" else 1) * (hours * 60 + minutes)
    if re.fullmatch(r"[A-IK-Za-ik-z]", token):
        return "zone_stated_minus_zero", "-0000", 0
    if token.lower() in ZONES:
        offset = ZONES[token.lower()]
        return "zone_stated", offset, (-1 if offset[0] == "-" else 1) * (int(offset[1:3]) * 60 + int(offset[3:]))
    return "zone_absent", None, None


def parse_date(value: str) -> tuple[str, str | None, str | None, str | None]:
    """(zone state, offset, UTC instant as RFC 3339 text, reason). No instant is ever invented."""
    text = value.replace("\r", "").replace("\n", "")
    while "(" in text and (shorter := _COMMENT.sub(" ", text)) != text:
        text = shorter
    m = _DATE.match(text.strip(" \t"))
    token = m["z"] if m else (text.split() or [""])[-1]
    state, offset, minutes = _zone(token or "")
    if not m or (m["z"] and state == "zone_absent"):
        return state, offset, None, INVALID
    year = int(m["y"])
    if len(m["y"]) == 2:
        year += 2000 if year < 50 else 1900
    elif len(m["y"]) == 3:
        year += 1900
    month = _MONTHS.get(m["mon"].lower(), 0)
    day, hour, minute, second = int(m["d"]), int(m["h"]), int(m["m"]), int(m["s"] or 0)
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    longest = (31, 28 + leap, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1] if month else 0
    named = not m["wd"] or m["wd"].lower() in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
    if not (month and named and 1 <= day <= longest and hour < 24 and minute < 60 and second <= 60 and 1 <= year <= 9999):
        return state, offset, None, INVALID
    if not m["z"]:
        return "zone_absent", None, None, NO_ZONE
    if minutes is None:
        return state, offset, None, INVALID
    total = days_from_civil(year, month, day) * 1440 + hour * 60 + minute - minutes
    days, rest = divmod(total, 1440)
    y, mo, d = civil_from_days(days)
    if not 1 <= y <= 9999:
        return state, offset, None, INVALID
    return state, offset, f"{y:04d}-{mo:02d}-{d:02d}T{rest // 60:02d}:{rest % 60:02d}:{second:02d}+00:00", None


_ID = re.compile(r"<[^<>]*>")


def project(name: str, value: str, status: str = "ok") -> tuple[str, str | None]:
    """(kind, scalar value) of a field by its name."""
    kind = kind_of(name, status)
    if kind == "text":
        return kind, decode_words(value)[0].strip()
    if kind == "message_id":
        return kind, value.strip()
    if kind == "message_id_list":
        found = _ID.findall(value)
        return kind, found[-1] if found else value.strip()
    if kind == "address_list":
        return kind, next((r["addr_spec"] for r in addresses(value.encode("latin-1")) if r["state"] == "parsed"), None)
    if kind == "date_time":
        return kind, parse_date(value)[2]
    return kind, None
