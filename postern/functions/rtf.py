"""Compressed RTF bodies: the LZFu and MELA forms, with every fault named."""

from __future__ import annotations

import struct
import zlib

#: Fixed value of the format: what the dictionary holds at first.
PRELOAD = b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"


def crc(data: bytes) -> int:
    """CRC-32 that begins with 0 and is not inverted at the end."""
    return zlib.crc32(data, 0xFFFFFFFF) ^ 0xFFFFFFFF


def expand(data: bytes) -> tuple[bytes, str | None]:
    """(bytes, fault): what could be read before the fault is kept."""
    if len(data) < 16:
        return b"", "short_header"
    size, raw_size, kind, check = struct.unpack_from("<II4sI", data)
    body = data[16 : size + 4]
    short = "truncated" if len(data) < size + 4 else None
    if kind == b"MELA":
        return body[:raw_size], short or ("size_mismatch" if len(body) < raw_size else None)
    if kind != b"LZFu":
        return b"", "unknown_form"
    window = bytearray(PRELOAD.ljust(4096, b"\0"))
    write, out, at = len(PRELOAD), bytearray(), 0

    def emit(byte: int) -> None:
        nonlocal write
        out.append(byte)
        window[write] = byte
        write = (write + 1) & 4095

    ended = False
    while at < len(body) and not ended and len(out) <= raw_size:
        flags = body[at]
        at += 1
        for bit in range(8):
            if at >= len(body):
                break
            if not flags >> bit & 1:
                emit(body[at])
                at += 1
                continue
            if at + 1 >= len(body):
                at = len(body)
                break
            token = body[at] << 8 | body[at + 1]
            at += 2
            offset, length = token >> 4, (token & 15) + 2
            if offset == write:
                ended = True
                break
            for k in range(length):
                emit(window[(offset + k) & 4095])
    fault = short or ("no_end" if not ended else "size_mismatch" if len(out) != raw_size else "bad_crc" if crc(body) != check else None)
    return bytes(out[:raw_size]), fault


def literal(text: bytes) -> bytes:
    """An LZFu stream of ``text`` without references, for rendered tables."""
    body, write = bytearray(), len(PRELOAD)
    for lo in range(0, len(text), 8):
        part = text[lo : lo + 8]
        write = (write + len(part)) & 4095
        if len(part) == 8:
            body += b"\0" + part
        else:
            body += bytes([1 << len(part)]) + part + struct.pack(">H", write << 4)
    if len(text) % 8 == 0:
        body += b"\1" + struct.pack(">H", write << 4)
    return struct.pack("<II4sI", len(body) + 12, len(text), b"LZFu", crc(bytes(body))) + bytes(body)
