"""Files of a tree as rows, what an ingest does with each, and the manifest that tells it."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.limits import Limits
from postern.operators import corpus, parse
from postern.shared import cut, exists
from postern.sources import messages

#: Why a file is skipped.
REASONS = ("file_unreadable", "file_over_cap", "symlinked_directory", "not_a_message", "unsupported_container")


def linked_folders(path: str) -> list[str]:
    """Relative paths of symbolic links to folders below a local ``path``, which a scan does not enter. Other stores have none."""
    root = path.removeprefix("file://")
    if "://" in root or not os.path.isdir(root):
        return []
    out, todo = [], [root]
    while todo:
        with os.scandir(todo.pop()) as entries:
            for e in entries:
                if e.is_symlink() and e.is_dir():
                    out.append(os.path.relpath(e.path, root))
                elif e.is_dir():
                    todo.append(e.path)
    return sorted(out, key=lambda p: p.encode())


def relative(path: Column, root: str) -> Column:
    """A scanned path below ``root``; a file that is the root itself keeps its name."""
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    base = root.split("://", 1)[-1].rstrip("/")
    base = "/" + base.split("/", 1)[-1] if "://" in root and not root.startswith("file:") else base
    return F.when(bare.startswith(base + "/"), F.substring(bare, len(base) + 2, 1 << 30)).otherwise(F.element_at(F.split(bare, "/"), -1))


def scan(spark: SparkSession, path: str, listing: Sequence[str] | None = None) -> DataFrame:
    """(path, size_bytes, raw) of the files below ``path``, paths relative to it. ``listing`` names the relative paths to read instead of the whole tree."""
    where = [f"{path.rstrip('/')}/{name}" for name in listing] if listing is not None else path
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    rows = files.select(relative(F.col("path"), path).alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))
    for link in linked_folders(path):
        rows = rows.where(~F.col("path").startswith(link + "/"))
    return rows


MANIFEST = "path string, container_hash string, outcome string, reason_id string"


def ingest_path(spark: SparkSession, path: str, store: str, limits: Limits, listing: Sequence[str] | None = None) -> DataFrame:
    """Parse what ``store`` lacks of the files below ``path`` and return the manifest, a row each: written, hit or skipped with its reason.

    Content that several files hold is written for the first of them in path order. The manifest is stored under its own
    fingerprint, so a second run over the same bytes writes no message, and only the manifest that names its hits.
    """
    files = scan(spark, path, listing)
    over = F.col("size_bytes") > limits.max_input_bytes
    kind = messages.sniffed(F.col("raw"))
    told = files.select("path", F.when(over, "file_over_cap").when(kind == "unknown", "not_a_message").alias("reason_id"), F.when(~over & (kind != "unknown"), F.sha2("raw", 256)).alias("container_hash"))
    told = cut(told.withColumn("document_key", F.when(F.col("reason_id").isNull(), corpus.document_key(F.col("container_hash"), limits))))
    held = f"{store}/messages"
    first = told.where("reason_id is null").groupBy("document_key").agg(F.min(F.encode("path", "UTF-8")).alias("first"))
    if exists(spark, held):
        first = first.join(spark.read.parquet(held).select("document_key"), "document_key", "left_anti")
    first = cut(first.select("document_key", F.decode("first", "UTF-8").alias("path")))
    new = files.join(first, "path").select("path", "document_key", "raw")
    rows = told.join(first.select("path", F.lit(True).alias("new")), "path", "left")
    outcome = F.when(F.col("reason_id").isNotNull(), "skipped").when(F.col("new"), "written").otherwise("hit")
    linked = spark.createDataFrame([(p, None, "skipped", "symlinked_directory") for p in linked_folders(path)], MANIFEST) if listing is None else None
    manifest = rows.select("path", F.when(F.col("reason_id").isNull(), F.col("container_hash")).alias("container_hash"), outcome.alias("outcome"), "reason_id")
    manifest = cut(manifest if linked is None else manifest.unionByName(linked))
    parse.parse_messages(new, limits).write.mode("append").parquet(held)
    manifest.write.mode("overwrite").parquet(f"{store}/manifests/{fingerprint(manifest, limits)}")
    return in_order(manifest)


def in_order(manifest: DataFrame) -> DataFrame:
    """Paths by their UTF-8 bytes, as Spark orders strings."""
    return manifest.orderBy("path")


def row_hash() -> Column:
    return F.sha2(F.concat_ws("\n", "path", F.coalesce("container_hash", F.lit("")), "outcome", F.coalesce("reason_id", F.lit(""))), 256)


def fingerprint(manifest: DataFrame, limits: Limits) -> str:
    """A hash of the rows in whatever order, and of the limits: word sums of row hashes, added up by executors."""
    words = [F.sum(F.conv(F.substring(row_hash(), 8 * k + 1, 8), 16, 10).cast("long")) for k in range(8)]
    found = manifest.agg(F.sha2(F.concat_ws("\n", F.lit(limits.stamp()), *[w.cast("string") for w in words]), 256)).first()[0]
    return found
