"""A compound-file message as the bytes of an RFC 5322 message, with rows that say where each stretch of them comes from.

A row is ``stream`` (source bytes as they are), ``reencoded`` (text of a source stream, as UTF-8) or ``synthetic`` (framing that
no source has). Parts of such a message are identified by their source, not by their place in the projected bytes.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from urllib.parse import quote

from postern.functions import mapi
from postern.functions.compound import Compound

CRLF = b"\r\n"
#: The boundary that no content may hold, media types and the names of charsets.
BOUNDARY, OPAQUE = b"=_msg_alt_", "application/octet-stream"
LABELS = {"cp65001": "utf-8", "cp20127": "us-ascii", "cp28591": "iso-8859-1", "cp28605": "iso-8859-15", "cp50220": "iso-2022-jp", "cp51949": "euc-kr", "cp54936": "gb18030", "cp20866": "koi8-r", "cp932": "shift_jis", "cp936": "gb2312", "cp949": "euc-kr", "cp950": "big5", "ascii": "us-ascii", "utf-8": "utf-8"}
SUPPORTED_METHODS = (1, 5, 6)


@dataclass(slots=True)
class Row:
    axis: str
    source: str
    source_at: int | None
    source_len: int | None
    source_sha256: str | None
    at: int = 0
    size: int = 0

    def part_id(self, container_hash: str) -> str:
        key = self.source if self.source_at is None else f"{self.source}:{self.source_at}:{self.source_len}"
        return hashlib.sha256("\n".join((container_hash, key, self.source_sha256 or "")).encode()).hexdigest()


@dataclass(slots=True)
class Projection:
    raw: bytes = b""
    rows: list[Row] = field(default_factory=list)
    gaps: list[tuple[str, str]] = field(default_factory=list)
    status: str = "parsed"
    reason: str | None = None


def charset_label(how: str | None) -> str:
    how = how or ""
    return LABELS.get(how) or (f"windows-{how[2:]}" if how.startswith("cp125") or how == "cp874" else "windows-1252")


def filename_parameter(name: str) -> str:
    """A quoted string where the name is plain ASCII, else the extended form: the name comes back byte for byte."""
    plain = name.isascii() and name.isprintable() and not set('"\\/;') & set(name)
    return f'filename="{name}"' if plain else "filename*=utf-8''" + quote(name, safe="")


def attachment_head(a: dict) -> bytes:
    disposition = "inline" if a["inline"] else "attachment"
    lines = [f"Content-Type: {a['mime'] or OPAQUE}", f"Content-Disposition: {disposition}" + (f"; {filename_parameter(a['filename'])}" if a["filename"] is not None else "")]
    if a["content_id"] is not None:
        cid = a["content_id"]
        lines.append(f"Content-ID: {cid if cid.startswith('<') and cid.endswith('>') else f'<{cid}>'}")
    return "\r\n".join([*lines, "Content-Transfer-Encoding: binary", "", ""]).encode()


class _Writer:
    def __init__(self):
        self.chunks: list[bytes] = []
        self.rows: list[Row] = []
        self.size = 0
        self.counts: dict[str, int] = {}

    def add(self, row: Row, *chunks: bytes) -> None:
        row.at, row.size = self.size, sum(map(len, chunks))
        self.size += row.size
        self.rows.append(row)
        self.chunks += chunks

    def made(self, role: str, chunk: bytes) -> None:
        n = self.counts[role] = self.counts.get(role, 0) + 1
        self.add(Row("synthetic", f"synthetic:{role}:{n}", None, None, None), chunk)


def _row(axis: str, name: str, data: bytes, at: int = 0, size: int | None = None) -> Row:
    return Row(axis, name, at, len(data) if size is None else size, hashlib.sha256(data).hexdigest())


def free_boundary(parts: list[bytes]) -> bytes:
    n = 0
    while any(BOUNDARY + str(n).encode() in p for p in parts):
        n += 1
    return BOUNDARY + str(n).encode()


def _transport(out: _Writer, text: str, name: str, data: bytes) -> None:
    """The message's own header lines, each with its place in the source stream."""
    for blank in ("\r\n\r\n", "\n\n"):
        if text.endswith(blank):
            text = text[: len(text) - len(blank) // 2]
            break
    wide = name.upper().endswith("001F")
    at = 3 if not wide and data.startswith(b"\xef\xbb\xbf") else 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        size = len(line.encode("utf-16-le")) if wide else data.find(b"\n", at) + 1 - at if b"\n" in data[at:] else len(data) - at
        out.add(_row("reencoded", name, data, at, size), line.encode("utf-8", "surrogatepass"))
        at += size


def project(file: Compound, found: dict | None = None) -> Projection:
    """The message of ``file`` as bytes that the MIME walk reads. Items of another class give none and the status ``unsupported``."""
    found = found or mapi.message(file)
    out = Projection()
    if file.long_difat:
        out.gaps.append(("msg.cfb_difat_extended", ""))
    if found["refused"]:
        out.status = "unsupported"
        out.gaps += [("msg.class_not_ipm_note", found["message_class"])] if found["message_class"] else []
        return out
    out.gaps += found["observations"]
    out.gaps += [("msg.embedded_depth_cap", f"{e['ordinal'] + 2}>{e['nested']}") for e in found["embedded"] if e["nested"] is not None]
    plain, html, transport = found["body"], found["html_data"], found["transport"]
    files = found["attachments"]
    w = _Writer()
    texts = [(plain or "").encode("utf-8", "surrogatepass"), html or b""]
    inner = free_boundary(texts)
    both = plain is not None and html is not None
    # the two boundaries differ where both are used: the end of the inner one would end the outer one too
    outer = free_boundary([*texts, *(a["data"] for a in files if a["data"] is not None), *([inner] if both else [])]) if files else b""
    label = charset_label(found["html_how"])
    html_head = f"Content-Type: text/html; charset={label}\r\nContent-Transfer-Encoding: binary\r\n".encode()
    plain_head = b"Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n"
    empty_head = b"Content-Type: text/plain; charset=us-ascii\r\nContent-Transfer-Encoding: 7bit\r\n"

    def body(head: bool) -> None:
        """One body leaf, with its own head where it is a part of something."""
        if html is not None:
            w.add(_row("stream", found["html_stream"], html), *([html_head + CRLF] if head else []), html)
        elif plain is not None:
            w.add(_row("reencoded", found["body_stream"], found["body_data"]), *([plain_head + CRLF] if head else []), texts[0])
        elif head:
            w.made("leaf", empty_head + CRLF)

    def alternatives() -> None:
        w.made("delimiter", b"--" + inner + CRLF)
        w.add(_row("reencoded", found["body_stream"], found["body_data"]), plain_head + CRLF, texts[0])
        w.made("delimiter", CRLF + b"--" + inner + CRLF)
        w.add(_row("stream", found["html_stream"], html), html_head + CRLF, html)
        w.made("delimiter", CRLF + b"--" + inner + b"--" + CRLF)

    if transport is not None and transport.startswith("\ufeff"):
        w.made("prelude", "\ufeff".encode())
        transport = transport[1:]
    kind = b'Content-Type: multipart/mixed; boundary="' + outer + b'"\r\n' if files else b'Content-Type: multipart/alternative; boundary="' + inner + b'"\r\n' if both else html_head if html is not None else plain_head if plain is not None else empty_head
    for line in [b"MIME-Version: 1.0\r\n", *kind.splitlines(keepends=True)]:
        w.made("structure", line)
    if transport is None:
        out.gaps.append(("msg.transport_headers_absent", ""))
    else:
        _transport(w, transport, found["transport_stream"], found["transport_data"])
    w.made("separator", CRLF)
    if files:
        w.made("delimiter", b"--" + outer + CRLF)
        if both:
            w.made("structure", b'Content-Type: multipart/alternative; boundary="' + inner + b'"\r\n\r\n')
            alternatives()
        else:
            body(True)
        for k, a in enumerate(files):
            w.made("delimiter", CRLF + b"--" + outer + CRLF)
            if a["data"] is not None:
                w.add(_row("stream", a["stream"], a["data"]), attachment_head(a), a["data"])
            else:
                w.add(Row("synthetic", f"synthetic:attachment:{k + 1}", None, None, None), attachment_head(a))
            if a["method"] is not None and int(a["method"]) not in SUPPORTED_METHODS:
                out.gaps.append(("msg.attachment_method_unsupported", f"{k}:{a['method']}"))
            elif a["method"] == "1" and a["data"] is None:
                out.gaps.append(("msg.stream_truncated", f"attach:{k}:stream_absent"))
                out.status, out.reason = "truncated", "stream_absent"
        w.made("delimiter", CRLF + b"--" + outer + b"--" + CRLF)
    elif both:
        alternatives()
    else:
        body(False)
    if found["rtf"] is not None or found["rtf_fault"]:
        if found["rtf_fault"]:
            out.gaps.append(("msg.stream_truncated", f"{mapi.stream_name(mapi.RTF, mapi.BINARY)}:{found['rtf_fault']}"))
            out.status, out.reason = "truncated", found["rtf_fault"]
        out.gaps.append(("msg.rtf_to_text_unsupported", ""))
    subject = found["subject"]
    if transport is not None and subject is not None:
        said = next((line.partition(":")[2].rstrip("\r").lstrip(" \t") for line in transport.split("\n") if line.lower().startswith("subject:")), None)
        if said is not None and said != subject:
            out.gaps.append(("headers.mapi_header_property_disagree", subject))
    out.raw = b"".join(w.chunks)
    out.rows = [Row("synthetic", "synthetic:root:1", None, None, None, 0, w.size), *w.rows]
    return out
