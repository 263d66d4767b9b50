import random

from postern.functions import mime
from postern.limits import Limits


def crlf(*lines: str) -> bytes:
    return "\r\n".join(lines).encode()


def tiled(raw: bytes, limits: Limits | None = None) -> mime.Message:
    message = mime.walk(raw, limits)
    at = 0
    for _, _, lo, size in sorted(message.regions, key=lambda r: (r[2], r[3])):
        assert lo == at, message.regions
        at += size
    assert at == len(raw)
    return message


def test_fields_keep_folds_and_malformed_lines():
    raw = crlf("A: one", " two", "broken line", "B:", "", "body")
    m = tiled(raw)
    assert [(f.name, f.value, f.status) for f in m.parts[0].fields] == [("A", " one\r\n two", "ok"), ("", "broken line", "unknown"), ("B", "", "ok")]
    assert m.parts[0].gaps == ["headers.malformed_line"]


def test_multipart_with_preamble_epilogue_and_missing_close():
    raw = crlf("Content-Type: multipart/mixed; boundary=x", "", "pre", "--x", "", "one", "--x ", "", "two", "--x--", "after")
    m = tiled(raw)
    assert [p.path for p in m.parts] == ["1", "1.1", "1.2"]
    assert {"body.preamble_bytes", "body.epilogue_bytes"} <= set(m.parts[0].gaps)
    assert [p.decoded for p in m.parts[1:]] == [b"one", b"two"]
    assert "body.boundary_disagreement" in tiled(crlf("Content-Type: multipart/mixed; boundary=x", "", "--x", "", "one")).parts[0].gaps


def test_caps_allow_their_value_and_record_one_more():
    raw = crlf("Content-Type: multipart/mixed; boundary=x", "", *sum((["--x", "", f"p{k}"] for k in range(4)), []), "--x--")
    assert len(tiled(raw, Limits(max_parts=5)).parts) == 5
    m = tiled(raw, Limits(max_parts=4))
    assert len(m.parts) == 4 and m.caps == [("1.4", "part_count_cap")]
    assert tiled(crlf("A: b", "", "12345"), Limits(max_decoded_part_bytes=5)).caps == []
    assert tiled(crlf("A: b", "", "123456"), Limits(max_decoded_part_bytes=5)).caps == [("1", "size_cap")]


def test_transfer_encodings_and_charsets():
    part = lambda *head, body: tiled(crlf(*head, "", "") + body).parts[0]
    assert part("Content-Transfer-Encoding: base64", body=b"SGVs\r\nbG8=").decoded == b"Hello"
    assert part("Content-Transfer-Encoding: base64", body=b"SGVs bG8").gaps == ["body.decode_fallback_used"]
    assert part("Content-Transfer-Encoding: quoted-printable", body=b"a=3Db").decoded == b"a=b"
    assert part("Content-Type: text/plain; charset=nope", body="é".encode()).used_charset == "utf-8"
    assert part("A: b", body=b"\xe9\x81").encoding_source == "fallback"


def test_tiling_holds_for_mutated_messages():
    raw = crlf("From: a@b", "Content-Type: multipart/mixed; boundary=x", "", "--x", "Content-Type: multipart/alternative; boundary=y", "", "--y", "", "t", "--y--", "--x--", "")
    rng = random.Random(7)
    for _ in range(400):
        data = bytearray(raw)
        for _ in range(rng.randint(1, 6)):
            k = rng.randrange(len(data))
            data[k : k + rng.randint(0, 3)] = bytes(rng.choice(b"\r\n-x: y;=\xef") for _ in range(rng.randint(0, 3)))
        tiled(bytes(data))


def test_sniff_and_prelude():
    assert mime.sniff(b"From x\nA: b\n\n") == "eml"
    assert mime.sniff(b"\xef\xbb\xbfA: b\r\n") == "eml"
    assert mime.sniff(b"\r\nA: b") == "unknown"
    assert mime.sniff(mime.COMPOUND_MAGIC + b"x") == "cfb"
    assert tiled(b"\xef\xbb\xbfFrom x\nA: b\n\nc").regions[0] == ("prelude", "1", 0, 10)
