"""Queries over compound-file messages rendered from conversations, the quality gates, and event windows read as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.operators import outlook, parse, quality
from postern.plans import mail
from postern.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEYS = ("conv_id", "turn")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlook.parse_compound(outlook.compound_mail(mail.table(spark, sf_dir, "conversations")))


@query("""SELECT conv_id, turn, 'IPM.Note' AS message_class, '★ ' || conv_id || '/' || turn AS subject, sha256(coalesce(text, '')) AS body_sha256, sha256(coalesce(text, '')) AS rtf_sha256,
  strftime(TIMESTAMP '2022-06-18 04:26:40' + to_minutes(CAST(conv_id % 1000 * 60 + turn AS INTEGER)), '%Y-%m-%dT%H:%M:%S+00:00') AS sent FROM conversations""")
def compound_messages(spark, sf_dir):
    """Class, subject, bodies and time of each compound file; the RTF body is expanded from its compressed form."""
    return files(spark, sf_dir).where("refused is null and rtf_fault is null").select(*KEYS, "message_class", "subject", F.sha2(F.encode("body", "UTF-8"), 256).alias("body_sha256"), F.sha2("rtf", 256).alias("rtf_sha256"), "sent")


@query("SELECT conv_id, turn, ['to', 'cc', 'bcc'][k + 1] AS role, coalesce(c.role, '') || ' ' || k AS name, 'p' || k || '.' || conv_id || '@example.test' AS address FROM conversations c, (SELECT unnest([0, 1, 2]) AS k)")
def compound_recipients(spark, sf_dir):
    return parse.rows_of(files(spark, sf_dir), "recipients", *KEYS)


@query("""SELECT conv_id, turn, 0 AS ordinal, 'note-' || turn || '.txt' AS filename, 'text/plain' AS mime, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS sha256 FROM conversations
  UNION ALL SELECT conv_id, turn, 1, 'zeros.bin', 'application/octet-stream', 5000 + turn, sha256(repeat(chr(0), CAST(5000 + turn AS INTEGER))) FROM conversations""")
def compound_attachments(spark, sf_dir):
    return parse.rows_of(files(spark, sf_dir), "attachments", *KEYS).select(*KEYS, "ordinal", "filename", "mime", "size", "sha256")


@query("SELECT type, count(*) AS n FROM conversations, (SELECT unnest(['001f', '001f', '001f', '0040', '0102']) AS type) GROUP BY type")
def compound_properties(spark, sf_dir):
    """Properties of the messages by type; none is faulty."""
    return parse.rows_of(files(spark, sf_dir), "properties", *KEYS).where("fault is null").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_files, CAST(0 AS BIGINT) AS n_bad, CAST(0 AS BIGINT) AS n_faults FROM conversations")
def compound_accounting(spark, sf_dir):
    """Every byte of a compound file belongs to one class, and no chain is faulty."""
    parsed = files(spark, sf_dir)
    total = F.aggregate("accounting", F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
    loose = F.exists("accounting", lambda x: (x["class"] == "unaccounted") & (x["bytes"] > 0))
    return parsed.agg(F.count("*").alias("n_files"), F.count_if((total != F.col("size_bytes")) | loose).alias("n_bad"), F.sum(F.size("faults")).alias("n_faults"))


@query("SELECT 'orphans' AS gate, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'silent_drops', 0 UNION ALL SELECT 'unnamed_caps', 0")
def quality_gates(spark, sf_dir):
    """Violations of each gate over the messages rendered from documents."""
    parsed = mail.documents(spark, sf_dir, "parts", "views", "caps")
    parts, views, caps = (parse.rows_of(parsed, name, "doc_id") for name in ("parts", "views", "caps"))
    found = {"orphans": quality.orphans(parts, "doc_id"), "silent_drops": quality.silent_drops(parts, views, caps, "doc_id"), "unnamed_caps": quality.unnamed_caps(caps, "doc_id")}
    rows = None
    for name, bad in found.items():
        one = bad.agg(F.lit(name).alias("gate"), F.count("*").alias("n"))
        rows = one if rows is None else rows.union(one)
    return rows


@query("""SELECT * FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL)
  WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def event_windows(spark, sf_dir):
    """Tumbling counts of events read as a stream, up to the last window that the watermark closes."""
    return ingest.closed_windows(spark, sf_dir, "events.parquet", "ts", "event_type", "6 hours", "10 minutes")
