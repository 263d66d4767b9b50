"""The structural kernel: message bytes to header fields, parts, regions and decoded bodies, with every byte in one region."""

from __future__ import annotations

import base64
import binascii
import hashlib
import quopri
import re
from dataclasses import dataclass, field

from postern.limits import Limits

BOM = b"\xef\xbb\xbf"
COMPOUND_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_LINE = re.compile(rb"([^\r\n]*)(\r\n|\r|\n|\Z)")
_NAME = re.compile(rb"[!-9;-~]+(?=:)")
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]+")


@dataclass(slots=True)
class Field:
    ordinal: int
    name: str
    value: str
    status: str
    name_at: int
    name_len: int
    value_at: int
    value_len: int
    at: int
    size: int


@dataclass(slots=True)
class Part:
    path: str
    parent: str | None
    content_type: str | None
    span: tuple[int, int]
    headers: tuple[int, int]
    body: tuple[int, int]
    fields: list[Field]
    declared_cte: str | None = None
    declared_charset: str | None = None
    used_cte: str | None = None
    used_charset: str | None = None
    fallback: bool = False
    encoding_source: str | None = None
    decoded: bytes | None = None
    gaps: list[str] = field(default_factory=list)
    part_id: str = ""

    def value(self, name: str) -> str | None:
        return next((f.value for f in self.fields if f.status == "ok" and f.name.lower() == name), None)


@dataclass(slots=True)
class Message:
    container_hash: str
    parts: list[Part]
    regions: list[tuple[str, str, int, int]]
    caps: list[tuple[str, str]]


def lines_of(raw: bytes, at: int, end: int):
    """(start, end of content, end of terminator); CRLF, LF and a lone CR each end a line."""
    while at < end:
        m = _LINE.match(raw, at, end)
        yield at, m.end(1), m.end()
        at = m.end()


def prelude_of(raw: bytes) -> int:
    """Bytes of a byte-order mark and a terminated mbox ``From `` line in front of the headers."""
    at = len(BOM) if raw.startswith(BOM) else 0
    if raw.startswith(b"From ", at) and (newline := raw.find(b"\n", at)) >= 0:
        at = newline + 1
    return at


def sniff(raw: bytes) -> str:
    """``cfb``, ``eml`` (a header line before the first blank line) or ``unknown``."""
    if raw.startswith(COMPOUND_MAGIC):
        return "cfb"
    for line in raw[prelude_of(raw) :].split(b"\n"):
        line = line.removesuffix(b"\r")
        if not line:
            break
        if _NAME.match(line):
            return "eml"
    return "unknown"


def split_head(raw: bytes, at: int, end: int) -> tuple[int, list[str]]:
    """Where the body begins: after the first empty line, or at the end."""
    for start, content, stop in lines_of(raw, at, end):
        if content == start:
            return stop, []
    return end, ["body.headers_only"]


def scan_fields(raw: bytes, at: int, end: int, codec: str = "latin-1") -> tuple[list[Field], list[str]]:
    """Header fields in order, folds joined to their field; a line that is neither is a row of unknown status."""
    out: list[Field] = []
    gaps: list[str] = []
    folds = False
    for start, content, stop in lines_of(raw, at, end):
        if content == start:
            break
        if folds and raw[start] in b" \t":
            f = out[-1]
            f.value_len, f.size = content - f.value_at, stop - f.at
            continue
        m = _NAME.match(raw, start, content)
        folds = m is not None
        colon = m.end() if m else start
        value_at = colon + 1 if m else start
        out.append(Field(len(out), raw[start:colon].decode(codec), "", "ok" if m else "unknown", start, colon - start, value_at, content - value_at, start, stop - start))
        if not m:
            gaps.append("headers.malformed_line")
    for f in out:
        f.value = raw[f.value_at : f.value_at + f.value_len].decode(codec)
    return out, gaps


_PIECE = re.compile(r'(?:"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[^";])*', re.DOTALL)


def media_of(value: str | None) -> tuple[str, dict[str, str]]:
    """Lower-cased media type and parameters, the first of each name; a ``;`` within quotes separates nothing."""
    pieces, at = [], 0
    value = value or ""
    while at <= len(value):
        m = _PIECE.match(value, at)
        pieces.append(m[0])
        at = m.end() + 1
    params: dict[str, str] = {}
    for piece in pieces[1:]:
        key, eq, v = piece.partition("=")
        key, v = key.strip().lower(), v.strip()
        if eq and key:
            if len(v) > 1 and v[0] == v[-1] == '"':
                v = v[1:-1].replace('\\"', '"').replace("\\\\", "\\")
            params.setdefault(key, v)
    return pieces[0].strip().lower(), params


def segment(raw: bytes, at: int, end: int, boundary: bytes):
    """(delimiter spans, child spans, epilogue start, closed) of a multipart body, or None without its boundary."""
    mark = re.compile(re.escape(b"--" + boundary) + rb"(--)?[ \t]*\Z")
    delimiters: list[tuple[int, int]] = []
    closed = False
    before = None
    for start, content, stop in lines_of(raw, at, end):
        m = mark.match(raw[start:content])
        if m:
            lo = before if before is not None else start
            if delimiters:
                lo = max(lo, delimiters[-1][1])
            delimiters.append((lo, stop))
            if m[1]:
                closed = True
                break
        before = content
    if not delimiters:
        return None
    opens = delimiters[:-1] if closed else delimiters
    children = [(d[1], delimiters[k + 1][0] if k + 1 < len(delimiters) else end) for k, d in enumerate(opens)]
    return delimiters, children, delimiters[-1][1] if closed else end, closed


def decode_transfer(payload: bytes, declared: str | None, budget: int) -> tuple[str | None, bytes | None, bool]:
    """(encoding used, bytes, fallback). Bytes are None where decoding would pass the budget."""
    cte = "7bit" if declared is None else declared.strip().lower()
    if cte == "quoted-printable":
        out = quopri.decodestring(payload)
    elif cte == "base64":
        compact = _SPACE.sub(b"", payload)
        if len(compact) // 4 * 3 - 2 > budget:
            return None, None, False
        try:
            out = base64.b64decode(compact, validate=True)
        except (binascii.Error, ValueError):
            return (None, payload, True) if len(payload) <= budget else (None, None, False)
    else:
        known = cte in ("7bit", "8bit", "binary")
        return (cte if known else None, payload, not known) if len(payload) <= budget else (None, None, False)
    return (cte, out, False) if len(out) <= budget else (None, None, False)


def pick_charset(body: bytes, declared: str | None) -> tuple[str, str, bool, str | None]:
    """(charset, its source, fallback, gap): declared, then ASCII, UTF-8 and windows-1252 strictly, then with replacements."""
    if not body:
        return "us-ascii", "ascii", False, None
    fell = False
    if declared:
        try:
            if isinstance(body.decode(declared), str):
                return declared, "declared_charset", False, None
        except (LookupError, ValueError):
            fell = True
    gap = "body.decode_fallback_used" if fell else None
    if body.isascii():
        return "us-ascii", "ascii", fell, gap
    for name, source in (("utf-8", "utf8_strict"), ("windows-1252", "windows_1252")):
        try:
            body.decode(name)
            return name, source, fell, gap
        except UnicodeDecodeError:
            pass
    return "windows-1252", "fallback", True, "body.decode_destroyed_bytes"


def part_id(container_hash: str, at: int, size: int, data: bytes) -> str:
    """Identity of a part by content: its container, its place and its bytes."""
    return hashlib.sha256("\n".join([container_hash, str(at), str(size), hashlib.sha256(data).hexdigest()]).encode()).hexdigest()


def walk(raw: bytes, limits: Limits | None = None) -> Message:
    """Parts in document order and regions that tile the bytes; an explicit stack, so depth costs no recursion."""
    limits = limits or Limits()
    message = Message(hashlib.sha256(raw).hexdigest(), [], [], [])
    left = limits.max_decoded_total_bytes
    todo: list[tuple] = [("part", "1", None, 0, len(raw), 0)]

    def unread(reason: str, path: str, lo: int, hi: int) -> None:
        message.regions.append((reason, path, lo, hi - lo))
        message.caps.append((path, reason))

    while todo:
        kind, path, parent, lo, hi, depth = todo.pop()
        if kind != "part":
            (unread(kind, path, lo, hi) if kind in CAPPED else message.regions.append((kind, path, lo, hi - lo)))
            continue
        if len(message.parts) >= limits.max_parts:
            unread("part_count_cap", path, lo, hi)
            continue
        head = lo + (prelude_of(raw[lo:hi]) if path == "1" else 0)
        body, gaps = split_head(raw, head, hi)
        if head > lo:
            message.regions.append(("prelude", path, lo, head - lo))
        if body - head > limits.max_header_bytes:
            unread("header_bytes_cap", path, head, hi)
            continue
        found, more = scan_fields(raw, head, body)
        gaps += more
        part = Part(path, parent, None, (lo, hi - lo), (head, body - head), (body, hi - body), found)
        media, params = media_of(part.value("content-type"))
        part.content_type = media or None
        declared = part.value("content-transfer-encoding")
        part.declared_cte = declared.strip().lower() if declared else None
        part.declared_charset = params.get("charset")
        part.part_id = part_id(message.container_hash, lo, hi - lo, raw[lo:hi])
        message.regions.append(("headers", path, head, body - head))
        cut = None
        if media.startswith("multipart/") and body < hi:
            boundary = params.get("boundary")
            cut = segment(raw, body, hi, boundary.encode("latin-1", "replace")) if boundary else None
            if cut is None:
                gaps.append("body.no_boundary_found")
        if cut:
            delimiters, children, epilogue, closed = cut
            if not closed:
                gaps.append("body.boundary_disagreement")
            if delimiters[0][0] > body:
                gaps.append("body.preamble_bytes")
                message.regions.append(("preamble", path, body, delimiters[0][0] - body))
            if epilogue < hi:
                gaps.append("body.epilogue_bytes")
                todo.append(("epilogue", path, None, epilogue, hi, 0))
            if closed:
                todo.append(("delimiter", path, None, *delimiters[-1], 0))
            for k in range(len(children) - 1, -1, -1):
                deep = depth + 1 > limits.max_depth
                todo.append(("depth_cap" if deep else "part", f"{path}.{k + 1}", path, *children[k], depth + 1))
                todo.append(("delimiter", path, None, *delimiters[k], 0))
        else:
            budget, reason = min((limits.max_decoded_part_bytes, "size_cap"), (left, "total_size_cap"), key=lambda x: x[0])
            part.used_cte, part.decoded, fell = decode_transfer(raw[body:hi], declared, budget)
            if part.decoded is None:
                unread(reason, path, body, hi)
            else:
                left -= len(part.decoded)
                message.regions.append(("body", path, body, hi - body))
                if fell:
                    gaps.append("body.decode_fallback_used")
                if part.content_type is None or part.content_type.startswith("text/"):
                    part.used_charset, part.encoding_source, fired, gap = pick_charset(part.decoded, part.declared_charset)
                    fell = fell or fired
                    if gap:
                        gaps.append(gap)
                part.fallback = fell
        part.gaps = list(dict.fromkeys(gaps))
        message.parts.append(part)
    return message


CAPPED = frozenset(("size_cap", "total_size_cap", "depth_cap", "part_count_cap", "header_bytes_cap"))
