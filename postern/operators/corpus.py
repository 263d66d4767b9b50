"""Relations across messages: keys, store, threads, candidates, times, terms, children, citations and quality checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from postern.limits import Limits
from postern.shared import cut

VERSION = "postern-1"


def document_key(container_hash: Column, limits: Limits) -> Column:
    """Hash of content, code version and limits: known before anything is parsed."""
    return F.sha2(F.concat_ws("\n", container_hash, F.lit(VERSION), F.lit(limits.stamp())), 256)


def not_stored(messages: DataFrame, store: DataFrame, limits: Limits, raw: str = "raw") -> DataFrame:
    """``messages`` that the store lacks, with container_hash and document_key: work that is done already is never parsed again."""
    keyed = messages.withColumn("container_hash", F.sha2(F.col(raw), 256))
    keyed = keyed.withColumn("document_key", document_key(F.col("container_hash"), limits))
    return keyed.join(store.select("document_key"), "document_key", "left_anti")


def thread_claims(fields: DataFrame, *keys: str) -> DataFrame:
    """(keys, message_id, parent_id, disagreement): the parent is the last id in References, else In-Reply-To. Nothing is threaded by subject."""
    ids = lambda name: F.max(F.when(F.lower("name") == name, F.regexp_extract_all("raw_value", F.lit("(<[^<>]*>)"))))
    rows = fields.where("parse_status = 'ok'").groupBy(*keys).agg(F.max(F.when(F.lower("name") == "message-id", F.trim("raw_value"))).alias("message_id"), ids("references").alias("refs"), ids("in-reply-to").alias("reply"))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    return rows.select(*keys, "message_id", F.coalesce(last("refs"), last("reply")).alias("parent_id"), F.coalesce(last("refs") != last("reply"), F.lit(False)).alias("disagreement"))


def thread_roots(claims: DataFrame) -> DataFrame:
    """(message_id, root_id, state): pointer jumping along parents, doubling the reach each round until nothing moves.

    ``claims`` may name parents that are not there. An id that several messages claim follows the least parent named, and is
    ``ambiguous`` if they name several. Ids that lead into a cycle have its least id as root and are ``cyclic``; all others are ``rooted``.
    """
    named = claims.where("message_id is not null").groupBy("message_id").agg(F.min("parent_id").alias("parent_id"), F.count_distinct("parent_id").alias("n"))
    first = named.select("message_id", F.coalesce("parent_id", "message_id").alias("root_id"), F.least("message_id", F.coalesce("parent_id", "message_id")).alias("least_id"), (F.col("n") > 1).alias("several"))
    up = cut(first.withColumn("moved", F.lit(True)))
    n, reach = up.count(), 1
    while True:
        to = up.select(F.col("message_id").alias("m"), F.col("root_id").alias("r"), F.col("least_id").alias("l"))
        far = F.coalesce("r", "root_id")
        up = cut(up.join(to, F.col("root_id") == F.col("m"), "left").select("message_id", far.alias("root_id"), F.least("least_id", F.coalesce("l", "least_id")).alias("least_id"), "several", (far != F.col("root_id")).alias("moved")))
        reach *= 2
        if up.where("moved").isEmpty():
            return up.select("message_id", "root_id", F.when(F.col("several"), "ambiguous").otherwise("rooted").alias("state"))
        if reach > n:
            break
    # what still moves goes round: where it has come to lies in the cycle, and has passed all of it
    ring = up.select(F.col("message_id").alias("m"), F.col("least_id").alias("l"))
    ends = up.join(ring, (F.col("root_id") == F.col("m")) & F.col("moved"), "left")
    return ends.select("message_id", F.coalesce("l", "root_id").alias("root_id"), F.when(F.col("l").isNotNull(), "cyclic").when(F.col("several"), "ambiguous").otherwise("rooted").alias("state"))


def same_message(bodies: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """Groups of messages with one Message-ID, body digest and view: the least key of each group, its size, and every member."""
    rows = bodies.join(ids, list(keys)).where("message_id is not null")
    groups = rows.groupBy("message_id", "body_digest", "media").agg(F.min(F.struct(*keys)).alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(groups, ["message_id", "body_digest", "media"]).select(*keys, "message_id", F.col("first"), "n")


def time_orders(events: DataFrame, doc: str = "doc", manifest: DataFrame | None = None) -> DataFrame:
    """(doc, policy, event_id, position or null where not placed). ``events``: doc, event_id, source, utc, ordinal, usable.

    ``manifest``: (doc, event_id, place), an order that the owner states; it is taken as it is, events that it lacks are not placed.
    """
    placed = {
        "header_date_claimed": (F.col("usable") & F.col("utc").isNotNull(), [F.col("utc"), F.col("event_id")]),
        "received_chain_header_order": (F.col("source") == "received", [-F.col("ordinal"), F.col("event_id")]),
    }
    out = []
    for policy, (ok, order) in placed.items():
        place = F.when(ok, F.row_number().over(W.partitionBy(doc, ok).orderBy(*order)))
        out.append(events.select(doc, F.lit(policy).alias("policy"), "event_id", place.alias("position")))
    if manifest is not None:
        stated = events.join(manifest.groupBy(doc, "event_id").agg(F.min("place").alias("place")), [doc, "event_id"], "left")
        order = F.row_number().over(W.partitionBy(doc, F.col("place").isNotNull()).orderBy("place", "event_id"))
        out.append(stated.select(doc, F.lit("owner_manifest").alias("policy"), "event_id", F.when(F.col("place").isNotNull(), order).alias("position")))
    return reduce(DataFrame.unionByName, out)


def time_conflicts(events: DataFrame, doc: str = "doc") -> DataFrame:
    """Pairs of one document's events that no policy reconciles: an unknown instant, two moments, or hops whose times contradict their chain."""
    a = events.select(doc, *[F.col(c).alias(f"a_{c}") for c in ("event_id", "source", "utc", "ordinal")])
    b = events.select(doc, *[F.col(c).alias(f"b_{c}") for c in ("event_id", "source", "utc", "ordinal")])
    both = a.join(b, (a[doc] == b[doc]) & (F.col("a_event_id") < F.col("b_event_id"))).drop(b[doc])
    hops = (F.col("a_source") == "received") & (F.col("b_source") == "received")
    unknown = F.col("a_utc").isNull() | F.col("b_utc").isNull()
    against = (F.col("a_utc") < F.col("b_utc")) != (F.col("a_ordinal") > F.col("b_ordinal"))
    clash = F.when(unknown, True).when(F.col("a_utc") == F.col("b_utc"), False).when(hops, against).otherwise(True)
    return both.where(clash).select(doc, "a_event_id", "b_event_id")


def term_hits(texts: DataFrame, terms: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, n_hits): whole-token occurrences of single-token terms, by one tokenisation and an equi-join on the token. Overlaps cannot occur."""
    tokens = texts.select(*keys, F.explode(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))).alias("term"))
    counts = tokens.groupBy(*keys, "term").agg(F.count("*").alias("n_hits"))
    return counts.join(terms.select("term").distinct(), "term").select(*keys, "term", "n_hits")


TOKEN = "[\\p{L}\\p{N}_]"


def _placed(runs: DataFrame, odd: bool, case_sensitive: bool, *keys: str) -> DataFrame:
    """(keys, ordinal, piece, place) of the tokens of each run, with ``odd`` of all other characters too."""
    names = [*keys, "ordinal"]
    source = runs.select(*names, "text")
    piece = "array<struct<piece: string, place: int>>"
    schema = T.StructType([*[source.schema[n] for n in names], *T.StructType.fromDDL(f"pieces {piece}").fields])
    pattern = re.compile(r"\w+|\W" if odd else r"\w+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        inner = arrow.field("pieces").type.value_type
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [[(m[0], m.start()) for m in pattern.finditer(t if case_sensitive else t.casefold())] if t else [] for t in part.column(len(names)).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                flat = [x for row in found for x in row]
                values = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], inner.field(0).type), pa.array([x[1] for x in flat], pa.int32())], fields=[inner.field(0), inner.field(1)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*[part.column(k).cast(arrow.field(k).type) for k in range(len(names))], lists.cast(arrow.field("pieces").type)], schema=arrow)

    return source.mapInArrow(run, schema).select(*names, F.inline("pieces"))


def match_terms(runs: DataFrame, terms: DataFrame, *keys: str, case_sensitive: bool = True) -> DataFrame:
    """(keys, term, start, end): whole-token occurrences of terms of any number of tokens, overlapping ones too, none across a run.

    ``runs``: keys, ordinal, text, at (where the run begins in its unit). A term is looked up by its first token, or by its
    first character if it has none, in an equi-join with the pieces of the runs; its places then meet their texts, where the rest is compared.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    given = terms.where("term <> ''").select("term", fold(F.col("term")).alias("needle")).distinct().withColumn("token", F.regexp_extract("needle", f"{TOKEN}+", 0))
    given = given.select("term", "needle", F.when(F.col("token") != "", F.col("token")).otherwise(F.substring("needle", 1, 1)).alias("piece"), F.when(F.col("token") != "", F.expr("locate(token, needle) - 1")).otherwise(0).alias("skip"), (F.col("token") == "").alias("odd"))
    odd = not given.where("odd").isEmpty()
    hits = _placed(runs, odd, case_sensitive, *keys).join(given, "piece").withColumn("begin", F.col("place") - F.col("skip")).where("begin >= 0")
    hits = hits.select(*keys, "ordinal", "term", "needle", "begin").join(runs.select(*keys, "ordinal", "at", fold(F.col("text")).alias("shown")), [*keys, "ordinal"])
    text = lambda at, n: F.substring(F.col("shown"), at.cast("int") + 1, n)
    size = F.length("needle")
    open_left = F.when(F.col("begin") > 0, ~text(F.col("begin") - 1, F.lit(1)).rlike(TOKEN)).otherwise(True)
    open_right = ~text(F.col("begin") + size, F.lit(1)).rlike(TOKEN)
    start = F.col("at") + F.col("begin")
    return hits.where((text(F.col("begin"), size) == F.col("needle")) & open_left & open_right).select(*keys, "term", start.cast("long").alias("start"), (start + F.length("term")).cast("long").alias("end"))


def runs_from_texts(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, ordinal, text, at): the texts of a unit, given as an array, one after another."""
    rows = texts.select(*keys, F.posexplode("texts").alias("ordinal", "text"))
    before = W.partitionBy(*keys).orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))


def flag_hits(hits: DataFrame, boundaries: DataFrame, *keys: str) -> DataFrame:
    """``hits`` (keys of a view, start, end, ...) with quote_ordinal and quote_kind of the innermost boundary around each: the one that begins last, of those the shortest. Null outside of all.

    The boundaries of a view travel as one array, bounded by the view's lines: no pairs of hits and boundaries are made.
    """
    around = boundaries.groupBy(*keys).agg(F.collect_list(F.struct("start", (-F.col("size")).alias("less"), "ordinal", "kind")).alias("around_"))
    inside = F.array_max(F.filter("around_", lambda b: (b["start"] <= F.col("start")) & (F.col("end") <= b["start"] - b["less"])))
    found = hits.join(around, list(keys), "left").withColumn("in_", inside)
    return found.select(*hits.columns, F.col("in_.ordinal").alias("quote_ordinal"), F.col("in_.kind").alias("quote_kind"))


def flag_rollup(hits: DataFrame, *keys: str, group: str = "term") -> DataFrame:
    """Counts of flagged hits per view, never across views: (keys, group, quote_ordinal, quote_kind, n, n_quoted). A summary, from which nothing is filtered."""
    return hits.groupBy(*keys, group, "quote_ordinal", "quote_kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("quote_kind") == "quote", F.lit(False))).alias("n_quoted"))


def thread_index(value: Column) -> Column:
    """What a Thread-Index header claims: its state, the 16 bytes that name the conversation, the time of its first message in ticks, and the number of replies. Never used for threading."""
    raw = F.try_to_binary(F.regexp_replace(value, "\\s", ""), F.lit("base64"))
    size = F.octet_length(raw)
    ok = (size >= 22) & ((size - 22) % 5 == 0)
    digits = F.hex(raw)
    ticks = F.conv(F.concat(F.substring(digits, 1, 12), F.lit("0000")), 16, 10).cast("decimal(20,0)")
    return F.when(ok, F.struct(F.lit("claimed").alias("state"), F.lower(F.substring(digits, 13, 32)).alias("conversation"), ticks.alias("ticks"), F.floor((size - 22) / 5).cast("int").alias("n_replies"))).when(value.isNotNull(), F.struct(F.lit("undecodable").alias("state"), F.lit(None).cast("string").alias("conversation"), F.lit(None).cast("decimal(20,0)").alias("ticks"), F.lit(None).cast("int").alias("n_replies")))


def same_name_versions(occurrences: DataFrame, thread: str, name: str, utc: str, key: str) -> DataFrame:
    """``occurrences`` whose filename occurs again in its thread, with version (by message date, unknown dates last), and whether the content is that of the version before."""
    rows = occurrences.where(F.col(name).isNotNull())
    group = W.partitionBy(thread, name)
    order = group.orderBy(F.col(utc).asc_nulls_last(), key)
    rows = rows.withColumns({"n_versions": F.count("*").over(group), "version": F.row_number().over(order), "same_content": F.coalesce(F.lag("sha256").over(order) == F.col("sha256"), F.lit(False))})
    return rows.where("n_versions > 1")


#: Fixed values of time evidence.
ORIGINS, PRECISIONS, AMBIGUITIES, TRUSTS = ("stated_in_text", "derived_by_named_rule", "absent"), ("year", "month", "day", "second"), ("none", "day_month", "timezone", "relative"), ("claimed", "derived", "user_supplied", "filesystem")


def invalid_times(events: DataFrame, *keys: str) -> DataFrame:
    """(keys, violation): evidence that claims more than it may, or a value out of its domain. Columns: when_raw, utc, offset, offset_origin, precision, ambiguity, trust, usable."""
    outside = lambda name, domain: ~F.coalesce(F.col(name).isin(*domain), F.lit(False))
    rules = {
        "offset of absent origin": (F.col("offset_origin") == "absent") & F.col("offset").isNotNull(), "relative time resolved": (F.col("ambiguity") == "relative") & F.col("utc").isNotNull(),
        "filesystem time orders arrivals": (F.col("trust") == "filesystem") & F.col("usable"), "no claim": F.coalesce(F.col("when_raw") == "", F.lit(True)), "usable unknown": F.col("usable").isNull(),
        "offset_origin": outside("offset_origin", ORIGINS), "precision": outside("precision", PRECISIONS), "ambiguity": outside("ambiguity", AMBIGUITIES), "trust": outside("trust", TRUSTS),
    }
    return events.select(*keys, F.explode(F.array_compact(F.array(*[F.when(bad, why) for why, bad in rules.items()]))).alias("violation"))


def link_children(occurrences: DataFrame, stores: DataFrame, version: str = VERSION) -> DataFrame:
    """Outcome of each occurrence's hash in stores that are probed in order: resolved, version_mismatch, child_absent or store_absent.

    ``occurrences``: occurrence_id, sha256. ``stores``: store_order, sha256, version (a store without rows cannot be listed here).
    """
    order = W.partitionBy("occurrence_id").orderBy(F.col("store_order").asc_nulls_last(), "version")
    rows = occurrences.join(stores, "sha256", "left").withColumn("k", F.row_number().over(order)).where("k = 1")
    none = stores.isEmpty()
    state = F.when(F.col("store_order").isNull(), "store_absent" if none else "child_absent").when(F.col("version") == version, "resolved").otherwise("version_mismatch")
    return rows.select("occurrence_id", "sha256", state.alias("outcome"), "store_order")


def cite(views: DataFrame, parts: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Raw bytes of code-point spans of exactly citable views: spans(keys, path, start, end) get at and size, or the reason why not."""
    rows = spans.join(views.where("media <> 'projection'").select(*keys, "path", "text", "precision", "precision_reason"), [*keys, "path"]).join(parts.select(*keys, "path", "body_at", "used_charset"), [*keys, "path"])
    wide = F.lower("used_charset").isin("utf-8", "us-ascii")
    width = lambda a, b: F.when(wide, F.octet_length(F.substring(F.col("text"), a + 1, b - a))).otherwise(b - a)
    ok = F.col("precision") == "exact"
    return rows.select(*keys, "path", "start", "end", F.when(ok, F.col("body_at") + width(F.lit(0), F.col("start"))).alias("at"), F.when(ok, width(F.col("start"), F.col("end"))).alias("size"), F.when(~ok, F.col("precision_reason")).alias("reason"))


def tiles(regions: Column, size: Column) -> Column:
    """Whether regions cover ``size`` bytes from the first on, each byte once."""
    placed = F.array_sort(F.transform(F.filter(regions, lambda r: r["size"] > 0), lambda r: F.struct(r["at"].alias("at"), r["size"].alias("size"))))
    end = F.aggregate(placed, F.lit(0).cast("long"), lambda at, r: F.when((at >= 0) & (r["at"] == at), at + r["size"]).otherwise(F.lit(-1).cast("long")))
    return end == size


def untiled(regions: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """Violations of the rule that regions tile a message: holes, overlaps and a wrong total. Empty when all is well."""
    order = W.partitionBy(*keys).orderBy("at", "size")
    rows = regions.where("size > 0").withColumn("before", F.coalesce(F.max(F.col("at") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    gaps = rows.where("at <> before").select(*keys, F.lit("hole or overlap").alias("violation"), F.col("at").alias("place"))
    total = regions.groupBy(*keys).agg(F.sum("size").alias("total")).join(sizes, list(keys)).where("total <> size_bytes").select(*keys, F.lit("wrong total").alias("violation"), F.col("total").alias("place"))
    return gaps.unionByName(total)
