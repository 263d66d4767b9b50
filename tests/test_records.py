"""Projection of compound files, documents and their JSON form, ingest with its manifest, terms, and literal cases of the rules."""

import os
import random
import re

from pyspark.sql import functions as F

from postern.functions import compound, html, mapi, mime, projection
from postern.limits import Limits
from postern.operators import corpus, documents, parse, quotes
from postern.sources import files


def project(**k):
    given = {"subject": "s", "body": None, "recipients": [], "attachments": [], "sent": 0} | k
    return projection.project(compound.read(compound.write(mapi.render(**given))))


def test_projected_bytes():
    assert project(body="hi").raw == b"MIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\nhi"
    assert project().raw == b"MIME-Version: 1.0\r\nContent-Type: text/plain; charset=us-ascii\r\nContent-Transfer-Encoding: 7bit\r\n\r\n"
    assert project(html=b"<p>x").raw == b"MIME-Version: 1.0\r\nContent-Type: text/html; charset=us-ascii\r\nContent-Transfer-Encoding: binary\r\n\r\n<p>x"
    both = project(body="a =_msg_alt_0", html=b"b", transport="From: a\r\nX: y\r\n\r\n")
    assert b'multipart/alternative; boundary="=_msg_alt_1"\r\nFrom: a\r\nX: y\r\n\r\n--=_msg_alt_1\r\nContent-Type: text/plain' in both.raw
    assert [r.axis for r in both.rows].count("reencoded") == 3
    files = project(body="t", html=b"<i>", attachments=[("n.txt", "text/plain", b"data", "c@x"), ("é.bin", None, b"\0"), ("m", None, None)])
    parts = mime.walk(files.raw).parts
    assert [(p.path, p.content_type) for p in parts] == [("1", "multipart/mixed"), ("1.1", "multipart/alternative"), ("1.1.1", "text/plain"), ("1.1.2", "text/html"), ("1.2", "text/plain"), ("1.3", "application/octet-stream"), ("1.4", "application/octet-stream")]
    assert b'inline; filename="n.txt"\r\nContent-ID: <c@x>\r\n' in files.raw and b"filename*=utf-8''%C3%A9.bin" in files.raw
    assert sum(r.size for r in files.rows[1:]) == len(files.raw) == files.rows[0].size
    assert project(subject="a", body="x", transport="Subject: b\n\n").gaps == [("headers.mapi_header_property_disagree", "a")]


def test_part_ids_of_a_projection_do_not_depend_on_its_framing(spark):
    raws = [(1, compound.write(mapi.render("s", "t", [], [("n", "text/plain", b"data")], 0)))]
    frame = spark.createDataFrame(raws, "i int, raw binary")
    rows = {r.path: r.part_id for r in parse.rows_of(parse.parse_messages(frame, want=("parts",)), "parts", "i").collect()}
    import hashlib

    stream = "__attach_version1.0_#00000000/__substg1.0_37010102"
    key = "\n".join((hashlib.sha256(raws[0][1]).hexdigest(), f"{stream}:0:4", hashlib.sha256(b"data").hexdigest()))
    assert rows["1.2"] == hashlib.sha256(key.encode()).hexdigest()


def test_what_is_asked_for_does_not_change_what_is_told(spark):
    draw = random.Random(2)
    lines = [b"From: a@b.example", b"Subject: =?utf-8?q?x?=", b"Date: Tue, 4 Mar 2025 10:00:00 +0000", b"Content-Type: text/html; charset=utf-8", b"bad line", b" fold", b"Subject: two", b""]
    raws = [(k, b"\r\n".join(draw.choice(lines) for _ in range(draw.randrange(9))) + b"\r\n\r\n<p>hi <img src='cid:x'>") for k in range(60)] + [(99, None), (100, b"")]
    frame = spark.createDataFrame(raws, "i int, raw binary")
    whole = {r.i: r for r in parse.parse_messages(frame).collect()}
    for want in (("fields", "dates", "header_gaps"), ("parts",), ("references", "dom_boundaries"), ("views", "regions", "addresses")):
        for r in parse.parse_messages(frame, want=want).collect():
            assert all(r[w] == whole[r.i][w] for w in want), (r.i, want)


def test_a_failing_stage_is_a_document_that_says_so(spark, monkeypatch):
    def broken(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(mime, "walk", broken)
    row = parse.parse_one(b"From: a\r\n\r\nx", Limits(), 16, frozenset(parse.WIDE))
    assert (row["status"], row["reason"], row["parts"], row["fields"]) == ("failed", "extractor_error", [], [])


def test_documents(spark):
    plain = b"Content-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\n  \r\n--b\r\nContent-Type: text/html\r\n\r\n<p>shown</p>\r\n--b--\r\n"
    deep = b"Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\n\r\n" + b"x" * 50 + b"\r\n--b\r\n\r\nshort\r\n--b--\r\n"
    frame = spark.createDataFrame([(1, plain), (2, deep), (3, b"From: a\r\n\r\n" + b"y" * 50), (4, None)], "i int, raw binary")
    limits = Limits(max_decoded_part_bytes=40)
    made = documents.assemble(parse.parse_messages(frame, limits, want=("parts", "views", "caps", "regions")), limits, "i")
    rows = {r.i: r for r in made.collect()}
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (rows[1].status, rows[1].content_fingerprint.body_digest, rows[1].content_fingerprint.view) == ("parsed", digest("shown"), "html")
    assert (rows[2].status, [(c.cap_id, c.cap_value, c.declared_size, c.path) for c in rows[2].cap_records]) == ("parsed", [("size_cap", 40, 50, "1.1")])
    assert rows[2].content_fingerprint.body_digest == digest("short")
    assert (rows[3].status, rows[3].reason) == ("skipped", "size_cap")
    assert rows[4].axes.children.state == "unknown" and rows[4].part_records[0].path == "1"
    text = documents.to_json(documents.identity(made, "i"))
    schema = documents.identity(made, "i").schema
    assert [r.fault for r in documents.from_json(text, schema).collect()] == [None] * 4
    odd = spark.createDataFrame([('{"status":"x","axes":{"children":{"state":"a","why":1}}}',), ("{",), ('{"part_records":[{"path":"1","size":3}]}',), (None,)], "json string")
    assert [r.fault for r in documents.from_json(odd, schema).collect()] == ["unknown field axes.children.why", "not_of_the_schema", "unknown field part_records[].size", "not_of_the_schema"]


def test_ingest_writes_once_and_tells_every_file(spark, tmp_path):
    root, store = tmp_path / "in", f"file://{tmp_path}/store"
    (root / "sub").mkdir(parents=True)
    (root / "é.eml").write_bytes(b"From: a@b\r\n\r\nx")
    (root / "sub" / "a.eml").write_bytes(b"From: a@b\r\n\r\nx")
    (root / "Z.eml").write_bytes(b"From: other\r\n\r\nx")
    (root / "n.bin").write_bytes(b"\0\1")
    (root / "big.eml").write_bytes(b"From: a@b\r\n\r\n" + b"x" * 200)
    os.symlink(root / "sub", root / "link")
    limits = Limits(max_input_bytes=100)
    tell = lambda: [(r.path, r.outcome, r.reason_id) for r in files.ingest_path(spark, f"file://{root}", store, limits).collect()]
    assert tell() == [("Z.eml", "written", None), ("big.eml", "skipped", "file_over_cap"), ("link", "skipped", "symlinked_directory"), ("n.bin", "skipped", "not_a_message"), ("sub/a.eml", "written", None), ("é.eml", "hit", None)]
    assert [x[1] for x in tell()] == ["hit", "skipped", "skipped", "skipped", "hit", "hit"]
    assert spark.read.parquet(f"{store}/messages").count() == 2
    listed = files.ingest_path(spark, f"file://{root}", store, limits, listing=["Z.eml"]).collect()
    assert [(r.path, r.outcome) for r in listed] == [("Z.eml", "hit")]
    assert len(list((tmp_path / "store" / "manifests").iterdir())) == 3


def test_terms_against_a_scan(spark):
    draw = random.Random(5)
    bits = ["a", "b", "ab", " ", "-", "_", "é", "😀", "@", "1", "a a", "\n"]
    texts = [(k, ["".join(draw.choice(bits) for _ in range(draw.randrange(12))) for _ in range(draw.randrange(1, 4))]) for k in range(60)]
    terms = ["a", "a a", "ab", "a-b", "@", "@a", "-", "a a a", "é", "b_", " ", "1 a", "A"]
    token = re.compile(r"\w")
    runs = corpus.runs_from_texts(spark.createDataFrame(texts, "k int, texts array<string>"), "k")
    given = spark.createDataFrame([(t,) for t in terms], "term string")
    for sensitive in (True, False):
        want = []
        for k, parts in texts:
            base = 0
            for part in parts:
                shown = part if sensitive else part.casefold()
                for t in terms:
                    needle, at = (t if sensitive else t.casefold()), -1
                    while (at := shown.find(needle, at + 1)) >= 0:
                        end = at + len(needle)
                        if not (at and token.match(shown[at - 1])) and not (end < len(shown) and token.match(shown[end])):
                            want.append((k, t, base + at, base + end))
                base += len(part)
        got = corpus.match_terms(runs, given, "k", case_sensitive=sensitive).collect()
        assert sorted((r.k, r.term, r.start, r.end) for r in got) == sorted(want)


def test_marks_in_html_and_vendor_gaps():
    told = lambda text: [(q["rule_id"], q["ordinal"], q["start"], q["end"]) for q in html.dom_quotes(html.parse(text))]
    assert told("<pre>x\n&gt; a\n&gt;&gt; b\ny\n&gt; c\n</pre>") == [("gt_family", 1, 2, 10), ("gt_family", 2, 13, 17)]
    assert told('<div class="gmail_quote">&gt; a\n</div>') == [("gmail_quote", 1, 0, 4)]
    gaps = lambda text: html.dom_gaps(t := html.parse(text), html.dom_quotes(t))
    assert gaps('<div id="x_divRplyFwdMsg2">a</div>') == ["body.html_quote_rule_gap"]
    assert gaps("<blockquote>a") == ["body.html_quote_rule_gap", "body.no_boundary_found"]
    assert gaps("<p>a</p>") == ["body.no_boundary_found"] and gaps('<div class="gmail_quote">x</div>') == []


def test_region_check(spark):
    rows = [(1, [(0, 3), (3, 2)], 5), (2, [(0, 3), (4, 1)], 5), (3, [(0, 3), (2, 3)], 5), (4, [], 0), (5, [(0, 4)], 5), (6, [(3, 2), (0, 3), (3, 0)], 5)]
    frame = spark.createDataFrame(rows, "i int, r array<struct<at: bigint, size: bigint>>, n long")
    assert [r.i for r in frame.where(corpus.tiles(F.col("r"), F.col("n"))).orderBy("i").collect()] == [1, 4, 6]


def test_quote_order_and_languages(spark):
    def told(text):
        lines = quotes.lines_of(spark.createDataFrame([(1, text)], "i int, text string"), "i")
        return [(r.rule_id, r.start) for r in quotes.boundaries(lines, "i").orderBy("start").collect()]

    assert told("From: a\nSubject: b\nTo: c\n") == []  # out of order
    assert told("From: a\nBetreff: b\n") == []  # of two languages
    assert told("From: a\nFrom: b\nTo: c\nx") == [("outlook_flat_en", 0)]
    assert told("On a\n\nwrote:\n") == []  # a blank line lies between
    assert told(" On x wrote:\n") == []
    assert told("_____________________________\n") == [] and told("______________________________ \n") == [("list_footer_underscores", 0)]
    assert told("--  \n-- x\n") == []


def test_body_text_is_cut_where_asked_and_says_why_there_is_none(spark):
    head = b"From: a@x\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"
    raws = [(1, head + "añb\r\nc".encode()), (2, b"From: a@x\r\nContent-Type: application/pdf\r\n\r\n%PDF"), (3, None), (4, b"\x00" * 40)]
    parsed = parse.parse_messages(spark.createDataFrame(raws, "i int, raw binary"), Limits(max_input_bytes=30), want=("parts", "views"))
    assert {r.i: (r.text, r.reason) for r in documents.body_text(parsed, "i").collect()}[4] == ("", "file_over_cap")
    parsed = parse.parse_messages(spark.createDataFrame(raws[:3], "i int, raw binary"), want=("parts", "views"))
    cut = {r.i: (r.view, r.path, r.text, r.char_count, r.truncated, r.reason) for r in documents.body_text(parsed, "i", max_chars=4).collect()}
    assert cut[1] == ("plain", "1", "añb\r", 4, True, None)
    assert cut[2] == ("plain", None, "", 0, False, "body.no_text_part")
    assert cut[3][2:5] == ("", 0, False)
    lines = documents.body_lines(documents.body_text(parsed, "i"), "i").orderBy("i", "unit").collect()
    assert [(r.i, r.unit, r.start, r.end) for r in lines] == [(1, 0, 0, 5), (1, 1, 5, 6)]
    for size in (0, documents.CHARS_CEILING + 1):
        try:
            documents.body_text(parsed, "i", max_chars=size)
        except ValueError:
            continue
        raise AssertionError("a size out of range was taken")


def test_axes_hold_a_value_or_a_reason(spark):
    parsed = parse.parse_messages(spark.createDataFrame([(1, b"From: a@x\r\n\r\nhi")], "i int, raw binary"), want=("parts", "views", "caps", "regions"))
    made = documents.assemble(parsed, Limits(), "i")
    assert documents.invalid_axes(made, "i").count() == 0
    state = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))
    bad = made.withColumn("axes", F.struct(state("value", "why").alias("children"), state("unknown", None).alias("thread_edges"), state("maybe", None).alias("times"), state("value", None).alias("same_message_candidates")))
    assert {(r.axis, r.violation) for r in documents.invalid_axes(bad, "i").collect()} == {("children", "a value with a reason"), ("thread_edges", "unknown without a reason"), ("times", "no such state")}


def test_flags_take_the_innermost_quote(spark):
    hits = spark.createDataFrame([(1, "t", 0, 2), (1, "t", 12, 14), (1, "t", 25, 27), (1, "t", 39, 41), (2, "t", 0, 1)], "i int, term string, start long, end long")
    found = spark.createDataFrame([(1, "quote", 1, 10, 30), (1, "quote", 2, 20, 10), (1, "signature", 0, 20, 15)], "i int, kind string, ordinal int, start long, size long")
    flagged = corpus.flag_hits(hits, found, "i")
    assert sorted((r.i, r.start, r.quote_ordinal, r.quote_kind) for r in flagged.where("start > 0").collect()) == [(1, 12, 1, "quote"), (1, 25, 2, "quote"), (1, 39, None, None)]
    rows = {(r.i, r.quote_ordinal): (r.n, r.n_quoted) for r in corpus.flag_rollup(flagged, "i").collect()}
    assert rows == {(1, None): (2, 0), (1, 1): (1, 1), (1, 2): (1, 1), (2, None): (1, 0)}


def test_html_projection_by_a_policy_of_the_caller():
    text = "<p>Keep <b>this</b></p><script>x</script><aside>not this</aside>"
    assert "".join(html.parse(text).pieces) == "Keep thisnot this"
    tree = html.parse(text, dropped=frozenset(("aside",)), shown=str.upper)
    assert "".join(tree.pieces) == "KEEP THISX" and [e.tag for e in tree.elements] == ["p", "b", "script", "aside"]


def test_owner_manifest_orders_what_it_names(spark):
    events = spark.createDataFrame([(1, k, "date", 10 - k, k, True) for k in range(3)], "doc int, event_id int, source string, utc int, ordinal int, usable boolean")
    manifest = spark.createDataFrame([(1, 2, 5), (1, 0, 7), (1, 2, 9), (1, 8, 1)], "doc int, event_id int, place int")
    rows = corpus.time_orders(events, manifest=manifest).where("policy = 'owner_manifest'").collect()
    assert {r.event_id: r.position for r in rows} == {2: 1, 0: 2, 1: None}
