"""Each query of the message engine on the smallest tables against its SQL, and a few relations by hand."""

import math
from pathlib import Path

import duckdb
import pytest

from postern import plans
from postern.limits import Limits
from postern.operators import corpus, parse, quotes

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def same(df, sql: str, con) -> None:
    result = con.sql(sql)
    columns = result.columns
    assert sorted(columns) == sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    mine = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    assert mine == sorted(repr(tuple(map(norm, r))) for r in result.fetchall())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_against_sql(spark, con, name):
    same(plans.QUERIES[name](spark, DATA), plans.SQL[name], con)


def boundaries(spark, text):
    views = spark.createDataFrame([("m", text)], "id string, text string")
    lines = quotes.lines_of(views, "id")
    return [(r.rule_id, r.kind, r.ordinal, list(r.prefix_depth), r.start, r.size) for r in quotes.boundaries(lines, "id").orderBy("start", "size", "rule_id").collect()]


def test_quote_rules(spark):
    assert boundaries(spark, "> a\r\n>> b\r\n\r\nanswer\r\n") == [("gt_family", "quote", 1, [1, 2], 0, 9)]
    assert boundaries(spark, "hi\n\nOn Monday, a\nb wrote:\n> x\n> y\n\nbye") == [("on_wrote_en", "quote", 1, [0, 0, 1, 1], 4, 29)]
    assert boundaries(spark, "x\nVon: a\nBetreff: b\ntext\n-- \nme") == [("outlook_flat_de", "quote", 1, [0, 0, 0], 2, 22), ("dash_dash_space", "signature", 0, [0, 0], 25, 6)]
    assert boundaries(spark, "Subject: a\nFrom: b\n") == []
    assert boundaries(spark, "") == []


def test_lone_cr_ends_a_line_and_offsets_are_code_points(spark):
    views = spark.createDataFrame([("m", "😀\ra b\r\n>c")], "id string, text string")
    rows = quotes.lines_of(views, "id").orderBy("line_no").collect()
    assert [(r.line, r.start, r.content_end, r.term_end, r.depth) for r in rows] == [("😀", 0, 1, 2, 0), ("a b", 2, 5, 7, 0), (">c", 7, 9, 9, 1)]


def test_null_empty_and_compound_messages(spark):
    rows = parse.parse_messages(spark.createDataFrame([(1, None), (2, b""), (3, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")], "id long, raw binary")).collect()
    assert [r.kind for r in rows] == ["unknown", "unknown", "cfb"]
    assert rows[2].parts == []


def test_untiled_finds_a_planted_hole(spark):
    regions = spark.createDataFrame([("m", 0, 5), ("m", 6, 4)], "id string, at long, size long")
    bad = corpus.untiled(regions, spark.createDataFrame([("m", 10)], "id string, size_bytes long"), "id").collect()
    assert {r.violation for r in bad} == {"hole or overlap", "wrong total"}


def test_keys_change_with_limits():
    assert Limits().stamp() != Limits(max_parts=3).stamp()


def test_whole_time_queries_take_every_event(spark):
    from pyspark.sql import functions as F

    events = plans.mail.table(spark, DATA, "events")
    n = events.count()
    orders = plans.QUERIES["time_orders"](spark, DATA)
    per_policy = {r.policy: (r["count"], r.e) for r in orders.groupBy("policy").agg(F.count("*").alias("count"), F.countDistinct("event_id").alias("e")).collect()}
    assert per_policy == dict.fromkeys(("header_date_claimed", "received_chain_header_order", "owner_manifest"), (n, n))
    late = plans.QUERIES["time_conflicts"](spark, DATA).groupBy("doc").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
    assert late > 12 * 11 // 2


def test_whole_citations_reach_the_end_of_each_body(spark):
    rows = plans.QUERIES["citations"](spark, DATA).collect()
    ends = {}
    for r in rows:
        ends[r.conv_id, r.turn] = max(ends.get((r.conv_id, r.turn), 0), r.offset + r.size)
    assert all(r.size is not None for r in rows) and max(ends.values()) > 64
    assert sum(ends.values()) == sum(r.size for r in rows)


def test_thread_roots_follow_long_chains_and_name_cycles(spark):
    chain = [(f"m{k:03d}", f"m{k - 1:03d}" if k else "gone") for k in range(300)]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("tail2", "tail1"), ("tail1", "r2"), ("self", "self"), ("alone", None), ("two", "a"), ("two", "b"), (None, "a")]
    claims = spark.createDataFrame(chain + ring, "message_id string, parent_id string")
    got = {r.message_id: (r.root_id, r.state) for r in corpus.thread_roots(claims).collect()}
    assert {got[m] for m, _ in chain} == {("gone", "rooted")}
    assert {got[m] for m in ("r1", "r2", "r3", "tail1", "tail2")} == {("r1", "cyclic")}
    assert (got["self"], got["alone"], got["two"]) == (("self", "rooted"), ("alone", "rooted"), ("a", "ambiguous"))
    assert corpus.thread_roots(claims.limit(0)).count() == 0


def test_scratch_deletes_what_is_not_kept(spark):
    from postern import shared

    with shared.scratch(spark) as kept:
        a, b = shared.cut(spark.range(3)), shared.cut(spark.range(4))
        kept.append(b)
    import pytest as p

    assert b.count() == 4
    with p.raises(Exception):
        spark.read.schema(a.schema).parquet(f"{shared.folder(spark)}/postern/{a.inputFiles()[0].split('/')[-2]}").collect()
    shared.forget(b)


def test_decode_chain_of_texts_that_are_empty(spark, tmp_path):
    texts = [None, "", " ", "\n", "a\r", "\r", "\r\n\r\n", "\ufeffa", "a\0b", "é"]
    spark.createDataFrame([(k, texts[k // 3]) for k in range(3 * len(texts))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    same(plans.QUERIES["decode_chain"](spark, str(tmp_path)), plans.SQL["decode_chain"], c)
