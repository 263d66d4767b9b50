"""Compound files, compressed RTF, quality gates and streaming ingest."""

import random

import pytest

from postern import plans
from postern.functions import compound, mapi, projection, rtf
from postern.operators import outlook, quality
from postern.limits import Limits
from postern.streaming import ingest

SAMPLE = bytes.fromhex("2d0000002b0000004c5a4675f1c5c7a703000a007263706731323542320af32068656c090020627705b06c647d0a800fa0")


def test_published_rtf_example():
    assert rtf.expand(SAMPLE) == (b"{\\rtf1\\ansi\\ansicpg1252\\pard hello world}\r\n", None)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 6000])
def test_literal_streams_round_trip(n):
    text = random.Random(n).randbytes(n)
    assert rtf.expand(rtf.literal(text)) == (text, None)


def test_rtf_faults():
    assert rtf.expand(b"short") == (b"", "short_header")
    assert rtf.expand(SAMPLE[:8] + b"ABCD" + SAMPLE[12:])[1] == "unknown_form"
    assert rtf.expand(SAMPLE[:12] + b"\0\0\0\0" + SAMPLE[16:])[1] == "bad_crc"
    assert rtf.expand(SAMPLE[:-6])[1] == "truncated"


def tree(n):
    return {"small": b"s" * 100, "Edge": b"e" * 4096, "below": b"b" * 4095, "none": b"", "box": {"inner": {"deep": b"d" * n}, "x": b"x"}, **{f"s{k}": bytes([k]) * k for k in range(60)}}


@pytest.mark.parametrize("n", [0, 63, 64, 65, 70_000])
def test_streams_round_trip_and_every_byte_has_a_class(n):
    raw = compound.write(tree(n))
    file = compound.read(raw)
    assert (file.error, file.faults) == (None, [])
    assert file.get("BOX/inner/DEEP") == b"d" * n and file.get("edge") == b"e" * 4096 and file.get("below") == b"b" * 4095 and file.get("none") == b""
    assert sum(file.accounting.values()) == len(raw) and file.accounting["unaccounted"] == 0


def test_damage_is_recorded_and_never_raises():
    raw = compound.write(tree(70_000))
    draw = random.Random(4)
    for _ in range(300):
        bad = bytearray(raw)
        for _ in range(draw.randrange(1, 30)):
            bad[draw.randrange(8, len(bad))] = draw.randrange(256)
        mapi.message(compound.read(bytes(bad[: draw.randrange(len(bad))])))
        file = compound.read(bytes(bad))
        assert file.error or sum(file.accounting.values()) == len(bad)
    assert compound.chain([1, 2, 0], 0, 3) == ([0, 1, 2], "cycle")
    assert compound.chain([9], 0, 3) == ([0], "out_of_range")


def test_other_classes_are_refused_and_pages_decide():
    item = mapi.render("s", "b", [], [], 0)
    item["__substg1.0_001A001F"] = "IPM.Appointment".encode("utf-16-le")
    assert mapi.message(compound.read(compound.write(item)))["refused"] == "not_a_mail_class"
    assert mapi.text8(b"\xe9", [1252]) == ("é", "cp1252") and mapi.text8("é".encode(), [99999]) == ("é", "utf-8") and mapi.text8(b"\xe9", []) == ("é", "cp1252")
    assert mapi.utc_of(133_000_000_000_000_000) == "2022-06-18T04:26:40+00:00" and mapi.utc_of(1 << 62) is None


def test_null_and_foreign_bytes(spark):
    rows = outlook.parse_compound(spark.createDataFrame([(1, None), (2, b"From: a\n\nb"), (3, compound.MAGIC)], "id long, raw binary")).collect()
    assert [r.error for r in rows] == ["no_header"] * 3 and rows[0].entries == []


def test_gates_find_planted_violations(spark):
    parts = spark.createDataFrame([("m", "1", None, True, "text/plain", "utf-8", []), ("m", "2.1", "2", True, "text/plain", "utf-8", ["body.gap"])], "id string, path string, parent_path string, is_leaf boolean, effective_type string, used_charset string, gaps array<string>")
    views = spark.createDataFrame([], "id string, path string")
    caps = spark.createDataFrame([("m", "3", "odd_cap"), ("m", "4", "depth_cap")], "id string, path string, reason string")
    assert [r.path for r in quality.silent_drops(parts, views, caps, "id").collect()] == ["1"]
    assert [r.path for r in quality.unnamed_caps(caps, "id").collect()] == ["3"]
    assert [r.path for r in quality.orphans(parts, "id").collect()] == ["2.1"]
    assert {(r.path, r.violation) for r in quality.differing(views, caps.select("id", "path").where("path = '3'"), "id", "path").collect()} == {("3", "missing")}
    files = spark.createDataFrame([(1, 5, None, [("header", 5)]), (2, 6, None, [("header", 5)]), (3, 6, None, [("header", 5), ("unaccounted", 1)])], "id int, size_bytes long, error string, accounting array<struct<class: string, bytes: long>>")
    assert {r.id: r.violation for r in quality.unaccounted(files, "id").collect()} == {2: "wrong total", 3: "bytes of no class"}


def test_streamed_files_are_parsed_once(spark, tmp_path):
    inbox, store, state = tmp_path / "in", f"file://{tmp_path}/store", f"file://{tmp_path}/state"
    inbox.mkdir()
    (inbox / "a.eml").write_bytes(b"From: a@example.test\r\n\r\nhi")
    (inbox / "copy.eml").write_bytes(b"From: a@example.test\r\n\r\nhi")
    for names in ((), ("again.eml", "new.eml")):
        for name in names:
            (inbox / name).write_bytes(b"From: a@example.test\r\n\r\n" + (b"hi" if name == "again.eml" else b"other"))
        for _ in range(2):
            ingest.ingest(spark, f"file://{inbox}", store, state)
        assert spark.read.parquet(f"{store}/messages").count() == 1 + bool(names)
    (inbox / "odd.bin").write_bytes(b"no message")
    (inbox / "big.eml").write_bytes(b"From: a@example.test\r\n\r\n" + b"x" * 300)
    ingest.ingest(spark, f"file://{inbox}", store, state, Limits(max_input_bytes=200))
    rows = spark.read.parquet(f"{store}/outcomes").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.outcome) for r in rows) == [("a.eml", "parse"), ("again.eml", "hit"), ("big.eml", "file_over_cap"), ("copy.eml", "parse"), ("new.eml", "parse"), ("odd.bin", "not_a_message")]


def test_observations_and_embedded_messages():
    deepest = mapi.render("deepest", None, [], [], 0)
    inner = mapi.render("inner", "text", [(1, "r", "r@example.test")], [("deepest.msg", None, deepest)], 0)
    extra = [(0x6001, mapi.UNICODE, "x"), (0x8005, mapi.UNICODE, "x"), (0x0C1A, mapi.STRING8, b"plain")]
    tree = mapi.render("outer", "text", [], [("inner.msg", None, inner)], 0, transport="Subject: outer\r\n\r\n", extra=extra)
    tree[mapi.TABLE] = tree[mapi.TABLE][:16] + (7).to_bytes(4, "little") + tree[mapi.TABLE][20:]
    file = compound.read(compound.write(tree))
    made = projection.project(file)
    assert sorted(made.gaps) == [
        ("msg.codepage_unresolved_ladder_used", ""), ("msg.embedded_depth_cap", "2>0"), ("msg.named_property_unresolved", "8005"),
        ("msg.property_tag_unknown", "6001:001f"), ("msg.recipient_table_unreadable", "declared=7 rows=0"),
    ]
    assert mapi.message(file)["embedded"] == [{"ordinal": 0, "message_class": "IPM.Note", "subject": "inner", "has_transport": False, "n_recipients": 1, "n_attachments": 1, "nested": 0}]


def test_eight_bit_text_of_a_declared_page_uses_no_ladder():
    pages = [(mapi.INTERNET_PAGE, mapi.I32, 1252), (0x0C1A, mapi.STRING8, b"caf\xe9")]
    file = compound.read(compound.write(mapi.render("s", "text", [], [], 0, transport="Subject: s\r\n\r\n", extra=pages)))
    assert projection.project(file).gaps == []
    bare = compound.read(compound.write(mapi.render("s", "text", [], [], 0, transport="Subject: s\r\n\r\n", extra=pages[1:])))
    assert [g for g, _ in projection.project(bare).gaps] == ["msg.codepage_unresolved_ladder_used"]


def kernels(plan) -> list:
    """The nodes of a plan that hand rows to Python."""
    below = [n for k in range(plan.children().size()) for n in kernels(plan.children().apply(k))]
    return [plan, *below] if plan.nodeName() == "MapInArrow" else below


#: Queries over compound files that are made and read in one pass; whole files are handed to no worker.
ONE_PASS = [
    "document_status",
    "compound_recipients",
    "msg_embedded",
    "compound_accounting",
]


@pytest.mark.parametrize("name", ONE_PASS)
def test_workers_are_handed_no_whole_files(spark, tmp_path, name):
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = kernels(plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().analyzed())
    assert found and all(len(kernels(x)) == 1 for x in found)
