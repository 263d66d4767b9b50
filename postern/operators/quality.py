"""Quality gates as relations of violations: empty where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.limits import CAPS


def silent_drops(parts: DataFrame, views: DataFrame, caps: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, violation): text leaves that have neither a view, nor a cap, nor a gap that says why."""
    leaves = parts.where("is_leaf and effective_type like 'text/%' and used_charset is not null and size(gaps) = 0").select(*keys, "path")
    shown = views.select(*keys, "path").union(caps.select(*keys, "path")).distinct()
    return leaves.join(shown, [*keys, "path"], "left_anti").withColumn("violation", F.lit("text without a view"))


def unnamed_caps(caps: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, violation): recorded caps whose reason belongs to no limit."""
    return caps.where(~F.col("reason").isin(*CAPS)).select(*keys, "path", F.concat(F.lit("no limit for "), "reason").alias("violation"))


def orphans(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, violation): parts whose parent is not there."""
    above = parts.select(*keys, F.col("path").alias("parent_path"))
    return parts.where("parent_path is not null").join(above, [*keys, "parent_path"], "left_anti").select(*keys, "path", F.lit("no parent").alias("violation"))


def unaccounted(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, violation): compound files whose classes of bytes do not add up to their size, or hold bytes of no class."""
    total = F.aggregate("accounting", F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
    loose = F.aggregate(F.filter("accounting", lambda x: x["class"] == "unaccounted"), F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
    bad = F.when(total != F.col("size_bytes"), "wrong total").when(loose > 0, "bytes of no class")
    return files.where("error is null").select(*keys, bad.alias("violation")).where("violation is not null")


def differing(measured: DataFrame, labelled: DataFrame, *keys: str) -> DataFrame:
    """(keys, violation): rows that only one of two relations of the same columns holds, with their number."""
    missing = labelled.exceptAll(measured).select(*keys, F.lit("missing").alias("violation"))
    return missing.union(measured.exceptAll(labelled).select(*keys, F.lit("unexpected")))
