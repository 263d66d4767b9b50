"""One record per message: status, caps, axes, body digest and keys, from the arrays of the wide row alone; and its JSON form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.limits import CAPS, Limits
from postern.operators import corpus, quotes
from postern.operators.bodies import effectively_empty, path_order

#: Axes that no stage builds: they are empty and say so.
AXES = ("children", "thread_edges", "times", "same_message_candidates")
NOT_BUILT = "not_built"
#: What depends on who made the record, and takes no part in its identity.
RECORDED = ("environment", "versions")


def cap_rows(limits: Limits) -> Column:
    """Caps that a message met: the limit's value, and the bytes that were left unread."""
    value = F.create_map(*[F.lit(x) for reason, field in CAPS.items() for x in (reason, int(getattr(limits, field)))])
    unread = lambda c: F.get(F.transform(F.filter("regions", lambda r: (r["kind"] == c["reason"]) & (r["path"] == c["path"])), lambda r: r["size"]), 0)
    return F.transform("caps", lambda c: F.struct(c["reason"].alias("cap_id"), value[c["reason"]].alias("cap_value"), unread(c).alias("declared_size"), c["path"].alias("path")))


def body_of() -> Column:
    """The body of a message as (path, media, text), read from its arrays: an HTML view if there is one that reads as text, else a plain one; of several the one that its group of alternatives selects, else the first.

    A group selects plain text, then HTML, then calendars, in document order; a blank plain text gives way.
    """
    bodies = F.filter("parts", lambda p: p["is_body"])
    groups = F.transform(F.filter("parts", lambda p: p["content_type"] == "multipart/alternative"), lambda p: p["path"])
    text = lambda path, media: F.get(F.transform(F.filter("views", lambda v: (v["path"] == path) & (v["media"] == media)), lambda v: v["text"]), 0)
    rank = lambda p: F.when((p["effective_type"] == "text/plain") & ~effectively_empty(F.coalesce(text(p["path"], F.lit("text/plain")), F.lit(""))), 1).when(p["effective_type"] == "text/html", 2).when(p["effective_type"] == "text/calendar", 3)
    ranked = F.transform(bodies, lambda p: F.struct(F.array_contains(groups, p["parent_path"]).alias("in_group"), F.coalesce(rank(p), F.lit(9)).alias("rank"), path_order(p["path"]).alias("order"), p["path"].alias("path"), p["effective_type"].alias("media"), p["parent_path"].alias("above"), p["used_charset"].isNotNull().alias("reads")))
    better = lambda x, y: (y["above"] == x["above"]) & ((y["rank"] < x["rank"]) | ((y["rank"] == x["rank"]) & (y["order"] < x["order"])))
    selected = lambda x: x["in_group"] & (x["rank"] < 9) & ~F.exists(ranked, lambda y: better(x, y))
    shown = F.filter(ranked, lambda x: x["reads"] & x["media"].isin("text/html", "text/plain"))
    place = F.array_min(F.transform(shown, lambda x: F.struct((x["media"] != "text/html").alias("plain"), (~selected(x)).alias("other"), x["order"].alias("order"), x["path"].alias("path"))))
    media = lambda p: F.when(p["plain"], "text/plain").otherwise("projection")
    return F.get(F.transform(F.array(place), lambda p: F.when(p["path"].isNotNull(), F.struct(p["path"].alias("path"), media(p).alias("media"), text(p["path"], media(p)).alias("text")))), 0)


def assemble(parsed: DataFrame, limits: Limits, *keys: str) -> DataFrame:
    """The document of each message: a pure function of its bytes and the limits. A message whose parse failed is a document that says so, without claims.

    ``parsed`` needs parts, views, caps and regions. No row meets another, so nothing is shuffled.
    """
    blank = lambda name: F.struct(F.lit("unknown").alias("state"), F.lit(NOT_BUILT).alias("reason")).alias(name)
    rows = parsed.withColumn("body", body_of())
    stamp = F.sha2(F.lit(limits.stamp()), 256)
    view = F.when(F.coalesce(F.col("body.media"), F.lit("")) == "projection", "html").otherwise("plain")
    return rows.select(
        *keys, corpus.document_key(F.col("container_hash"), limits).alias("document_key"), "container_hash", F.when(F.col("kind") == "cfb", "cfb_msg").otherwise("eml").alias("container_kind"), "size_bytes", "status", "reason",
        F.sha2(F.concat_ws("\n", "container_hash", F.lit(corpus.VERSION), stamp), 256).alias("run_id"), stamp.alias("limits_fingerprint"), cap_rows(limits).alias("cap_records"),
        F.transform("parts", lambda p: F.struct(p["part_id"].alias("part_id"), p["path"].alias("path"), p["effective_type"].alias("media"), p["body_sha256"].alias("sha256"))).alias("part_records"),
        F.struct(F.sha2(F.coalesce("body.text", F.lit("")), 256).alias("body_digest"), view.alias("view")).alias("content_fingerprint"), F.struct(*[blank(a) for a in AXES]).alias("axes"),
        F.create_map().cast("map<string,string>").alias("environment"), F.create_map(F.lit("postern"), F.lit(corpus.VERSION)).alias("versions"),
    )


#: Characters that a reader gets unless it asks otherwise, and the most it may ask for.
MAX_CHARS, CHARS_CEILING = 1_000_000, 2_000_000


def body_text(parsed: DataFrame, *keys: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """(keys, view, path, text, char_count, truncated, reason) of each message's body. Without a body the text is empty and the reason says so; a message that was not read gives its own reason.

    ``parsed`` needs parts and views.
    """
    if not 1 <= max_chars <= CHARS_CEILING:
        raise ValueError(f"max_chars must be in 1..{CHARS_CEILING}, got {max_chars}")
    rows = parsed.withColumn("body", body_of())
    text = F.coalesce("body.text", F.lit(""))
    view = F.when(F.coalesce(F.col("body.media"), F.lit("")) == "projection", "html").otherwise("plain")
    refused = F.when(F.col("status").isin("skipped", "failed", "unsupported"), F.coalesce("reason", "status"))
    reason = F.when(F.col("body.path").isNull(), F.coalesce(refused, F.lit("body.no_text_part")))
    return rows.select(*keys, view.alias("view"), F.col("body.path").alias("path"), F.substring(text, 1, max_chars).alias("text"), F.least(F.length(text), F.lit(max_chars)).alias("char_count"), (F.length(text) > max_chars).alias("truncated"), reason.alias("reason"))


def body_lines(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, view, path, unit, start, end): the lines of ``body_text``, which they tile; a line keeps its end. No lines without text."""
    lines = quotes.lines_of(texts.select(*keys, "view", F.coalesce("path", F.lit("")).alias("path"), "text"), *keys, "view", "path")
    return lines.select(*keys, "view", "path", F.col("line_no").alias("unit"), "start", F.col("term_end").alias("end"))


def invalid_axes(documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, axis, violation): axes that neither hold a value nor say why they hold none."""
    known, reason = F.col("a.state") == "value", F.col("a.reason").isNotNull()
    bad = F.when(~F.col("a.state").isin("value", "unknown"), "no such state").when(known & reason, "a value with a reason").when(~known & ~reason, "unknown without a reason")
    each = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"axes.{a}").alias("a")) for a in AXES])
    return documents.select(*keys, F.inline(each)).select(*keys, "axis", bad.alias("violation")).where("violation is not null")


def identity(documents: DataFrame, *keys: str) -> DataFrame:
    """``documents`` without what is only recorded: two runs over the same bytes agree on every byte of it."""
    return documents.drop(*RECORDED, *keys)


def to_json(documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, json): one line each, fields in schema order, nulls written."""
    fields = [c for c in documents.columns if c not in keys]
    return documents.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def unknown_fields(text: Column, schema: T.DataType) -> Column:
    """Names in a JSON text, at any depth, that its schema lacks, as dotted paths."""

    def at(value: Column, kind: T.DataType, path: str) -> list[Column]:
        if isinstance(kind, T.ArrayType):
            if not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
                return []
            each = F.from_json(value, "array<string>")
            inner = lambda x: reduce(F.concat, at(x, kind.elementType, f"{path}[]"), F.array().cast("array<string>"))
            return [F.coalesce(F.flatten(F.transform(each, inner)), F.array().cast("array<string>"))]
        if not isinstance(kind, T.StructType):
            return []
        names = F.array(*[F.lit(f.name) for f in kind.fields])
        here = F.transform(F.array_except(F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")), names), lambda n: F.concat(F.lit(f"{path}." if path else ""), n))
        return [here, *[x for f in kind.fields for x in at(F.get_json_object(value, f"$.{f.name}"), f.dataType, f"{path}.{f.name}" if path else f.name)]]

    return reduce(F.concat, at(text, schema, ""), F.array().cast("array<string>"))


def from_json(rows: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    """``rows`` with record and fault: a text that is no JSON of the schema, or names a field that it lacks, has a fault and no record."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    read = F.from_json(column, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    extra = unknown_fields(F.col(column), schema)
    rows = rows.withColumns({"read_": read, "extra_": extra})
    fault = F.when(F.col("read_").isNull() | F.col("read_._bad").isNotNull(), "not_of_the_schema").when(F.size("extra_") > 0, F.concat(F.lit("unknown field "), F.get("extra_", 0)))
    return rows.withColumn("fault", fault).withColumn("record", F.when(F.col("fault").isNull(), F.struct(*[F.col("read_").getField(f.name).alias(f.name) for f in schema.fields]))).drop("read_", "extra_")
