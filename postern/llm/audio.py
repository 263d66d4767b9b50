"""Telephony audio in columns: G.711 mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, PCM out.

The stored form is a RIFF/WAVE file of one channel. Codes are 8-bit samples, so any bytes are a lossless mu-law or A-law
stream, and any bytes in whole blocks an IMA one. The blocks of many clips are decoded together.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postern.llm.common import long, map_texts, string

PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
RATE = 8000
#: Samples that are expanded at once.
CHUNK = 1 << 18


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, step = (code & 0x0F) << 4, (code >> 4) & 7
    size = np.where(step == 0, part + 8, (part + 0x108) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
SHIFTS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
# Fixed values of the IMA format: index shifts above, step sizes here.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """PCM of mono IMA ADPCM. Blocks advance together, a nibble at a time; decode_many() adds last short blocks."""
    n = len(data) // block
    if block < 5 or not n:
        return np.zeros(0, np.int16)
    out = np.empty((n, 2 * (block - 4) + 1), np.int16)
    every = np.frombuffer(data, np.uint8, n * block).reshape(n, block)
    for at in range(0, n, max(1, CHUNK // block)):
        rows = every[at : at + max(1, CHUNK // block)]
        value = rows[:, :2].copy().view("<i2").astype(np.int32).ravel()
        index = np.minimum(rows[:, 2].astype(np.int32), 88)
        codes = np.stack([rows[:, 4:] & 15, rows[:, 4:] >> 4], axis=2).reshape(len(rows), -1).T.astype(np.int32)
        made = np.empty((len(codes) + 1, len(rows)), np.int16)
        made[0] = value
        for k, code in enumerate(codes):
            step = STEPS[index]
            move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + SHIFTS[code], 0, 88)
            made[k + 1] = value
        out[at : at + len(rows)] = made.T
    return out.ravel()


def decode_many(clips: list[tuple[bytes, int]]) -> list[np.ndarray | ValueError]:
    """PCM of IMA ADPCM streams (data, block): the whole blocks of all clips of one block size together, then each last short block by itself. A ValueError in place of a clip that has a block without its header."""
    out: list[np.ndarray | ValueError] = [np.zeros(0, np.int16)] * len(clips)
    by_size: dict[int, list[int]] = {}
    for k, (data, block) in enumerate(clips):
        tail = len(data) % block if block >= 5 else 0
        if block < 5:
            out[k] = ValueError(f"IMA block of {block} bytes")
        elif 0 < tail < 4:
            out[k] = ValueError(f"last IMA block of {tail} bytes has no header")
        else:
            by_size.setdefault(block, []).append(k)
    for block, members in by_size.items():
        whole = [len(clips[k][0]) // block for k in members]
        pcm = decode_ima(b"".join(clips[k][0][: n * block] for k, n in zip(members, whole, strict=True)), block)
        each = 2 * (block - 4) + 1
        ends = np.cumsum(whole) * each
        for k, n, end in zip(members, whole, ends.tolist(), strict=True):
            tail = clips[k][0][n * block :]
            last = [decode_ima(tail, len(tail)) if len(tail) > 4 else np.frombuffer(tail, "<i2", 1).astype(np.int16)] if tail else []
            out[k] = np.concatenate([pcm[end - n * each : end], *last])
    return out


#: Fraction bits of a filter tap. Sums of 16-bit samples and such taps are exact in float64, in whatever order they are added.
TAP_BITS = 14


def resample(x: np.ndarray, old: int, new: int, half: int = 16) -> np.ndarray:
    """Polyphase windowed-sinc resampling of 16-bit PCM: one filter for each phase, run over all its outputs at once."""
    g = gcd(old, new)
    up, down = new // g, old // g
    if up == down or not len(x):
        return x.astype(np.int16)
    wide = half * max(up, down)
    t = np.arange(-wide, wide + 1)
    taps = np.rint((1 << TAP_BITS) * np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1] * min(1.0, up / down))
    n = (len(x) * up + down - 1) // down
    out = np.empty(n, np.int16)
    reach = wide // up + 1
    padded = np.concatenate([np.zeros(reach, np.int16), x.astype(np.int16), np.zeros(reach + 1, np.int16)])
    offsets = np.arange(-reach, reach + 1)
    for first in range(min(up, n)):  # outputs first, first + up, ... are of one phase
        base, phase = divmod(first * down, up)
        k = phase - offsets * up + wide
        h = np.where((k >= 0) & (k < len(taps)), taps[np.clip(k, 0, len(taps) - 1)], 0)
        count = len(range(first, n, up))
        for lo in range(0, count, CHUNK):
            hi = min(count, lo + CHUNK)
            part = padded[base + lo * down : base + (hi - 1) * down + len(h)].astype(np.float64)
            total = np.correlate(part, h, "valid")[::down] if down <= 8 else np.lib.stride_tricks.sliding_window_view(part, len(h))[::down] @ h
            out[first + lo * up : first + (hi - 1) * up + 1 : up] = np.clip(np.floor((total + (1 << TAP_BITS - 1)) / (1 << TAP_BITS)), -32768, 32767)
    return out


def write_wave(data: bytes, tag: int, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * block if tag != IMA else rate, block, bits, 0)
    pad = b"\0" * (len(data) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and data bytes; ValueError for other bytes."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            if size < 16 or at + 24 > len(media):
                raise ValueError("short format chunk")
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            if fmt is None or at + 8 + size > len(media):
                raise ValueError("data before its format, or cut short")
            if fmt[1] != 1:
                raise ValueError("more than one channel")
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def to_pcm(clips: list[bytes | None]) -> list[tuple[np.ndarray, int] | ValueError | None]:
    """(PCM, rate) of each RIFF/WAVE clip, or the error that says why it has none."""
    out: list[tuple[np.ndarray, int] | ValueError | None] = [None] * len(clips)
    blocks: list[tuple[int, int, bytes, int]] = []
    for k, c in enumerate(clips):
        if c is None:
            continue
        try:
            tag, rate, block, data = read_wave(c)
            if tag in TABLES:
                out[k] = TABLES[tag][np.frombuffer(data, np.uint8)], rate
            elif tag == IMA:
                blocks.append((k, rate, data, block))
            elif tag == PCM and block == 2:
                out[k] = np.frombuffer(data[: len(data) // 2 * 2], "<i2"), rate
            else:
                raise ValueError(f"format {tag} is not supported")
        except ValueError as e:
            out[k] = e
    for (k, rate, _, _), pcm in zip(blocks, decode_many([(data, block) for _, _, data, block in blocks]), strict=True):
        out[k] = pcm if isinstance(pcm, ValueError) else (pcm, rate)
    return out


def expand_audio(df: DataFrame, media: str = "media", rate: int = 16000) -> DataFrame:
    """``df`` with pcm (16-bit little endian at ``rate``), n_samples and audio_error.

    IMA clips are decoded to the last byte, a short last block too; one too short for its header is an error. Null media
    give nulls; media that cannot be decoded give null pcm and the reason in audio_error. Other columns pass.
    """

    def make():
        def fn(clips):
            pcm, n, error = [], [], []
            for found in to_pcm([None if c is None else bytes(c) for c in clips]):
                x = resample(*found, rate) if isinstance(found, tuple) else None
                pcm.append(None if x is None else x.astype("<i2").tobytes())
                n.append(None if x is None else len(x))
                error.append(str(found) if isinstance(found, ValueError) else None)
            return [pcm, n, error]

        return fn

    return map_texts(df, make, [T.StructField("pcm", T.BinaryType()), long("n_samples"), string("audio_error")], media, slice_rows=32)


def features(pcm: np.ndarray) -> str:
    """Samples, mean square, zero crossings and peak of PCM, in exact integers."""
    power = crossings = peak = 0
    last = None
    for at in range(0, len(pcm), CHUNK):
        x = pcm[at : at + CHUNK].astype(np.int64)
        power += int((x * x).sum())
        peak = max(peak, int(np.abs(x).max(initial=0)))
        sign = x < 0
        crossings += int((sign[1:] != sign[:-1]).sum()) + int(last is not None and bool(sign[0]) != last)
        last = bool(sign[-1])
    return f"samples={len(pcm)};mean_square={power // max(1, len(pcm))};crossings={crossings};peak={peak}"


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


#: Formats that payloads are stored in, and bytes of an IMA block: payloads are whole blocks.
FORMATS, IMA_BLOCK, OUT_RATE = (MULAW, ALAW, IMA), 64, 16000


def store(payload: bytes) -> bytes:
    """A clip of the payload's bytes, in the format that their checksum chooses."""
    tag = FORMATS[zlib.crc32(payload) % len(FORMATS)]
    return write_wave(payload, tag, block=IMA_BLOCK, bits=4) if tag == IMA else write_wave(payload, tag)


def store_texts(docs: DataFrame, text: str = "text", with_media: bool = False) -> DataFrame:
    """Each text's UTF-8 bytes, zero-padded to a positive multiple of 64, stored as a mu-law, A-law or IMA ADPCM clip, read back, decoded and resampled.

    A null text counts as empty. Equal texts give equal values: the bytes choose the format. ``feature`` tells the format, the
    decoded samples and the checksum of the PCM at ``OUT_RATE``. ``with_media`` adds the clip (media) and that PCM (pcm).
    """

    def make():
        def fn(texts):
            rows = []
            clips = [store(payload_of(t)) for t in texts]
            for t, media, found in zip(texts, clips, to_pcm(clips), strict=True):
                tag, _, _, back = read_wave(media)
                pcm, rate = found
                out = resample(pcm, rate, OUT_RATE).astype("<i2").tobytes()
                feature = f"format={tag};{features(pcm)};pcm_{OUT_RATE}={zlib.crc32(out):08x}"
                rows.append((len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, *([media, out] if with_media else [])))
            return [list(c) for c in zip(*rows, strict=True)] or [[]] * (7 + 2 * with_media)

        return fn

    fields = [long("n_bytes"), long("payload_bytes"), string("payload_sha256"), long("tail_crc32"), long("media_bytes"), string("media_sha256"), string("feature")]
    more = [T.StructField("media", T.BinaryType()), T.StructField("pcm", T.BinaryType())] if with_media else []
    return map_texts(docs, make, fields + more, text, keep=[c for c in docs.columns if c != text], slice_rows=64)
