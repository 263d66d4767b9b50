"""Tables in the folder that the driver and all executors share: lineage ends there and survives lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names. Only where driver and executors are one process may it be left out: a temporary one is set then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='postern-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    return f"{folder(spark)}/postern/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _paths(df: DataFrame) -> set[str]:
    """Names of the folders that cut() wrote for ``df``."""
    files = [f"{df._cut}/"] if hasattr(df, "_cut") else df.inputFiles()
    return {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in files}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete what cut() wrote for ``df``; later reads of it fail."""
    for name in _paths(df):
        _delete(df.sparkSession, f"{folder(df.sparkSession)}/postern/{name}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What cut() writes inside is deleted at the end, but for the tables that are put into the list given."""
    made: list[str] = []
    kept: list[DataFrame] = []
    before = _made.set(made)
    try:
        yield kept
    finally:
        _made.reset(before)
        names = set().union(*map(_paths, kept))
        for path in made:
            if path.rsplit("/", 1)[-1] not in names:
                _delete(spark, path)
            elif (outer := _made.get()) is not None:
                outer.append(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Queries that run inside hand rows to Python workers in Arrow batches of at most ``size``: for rows of many KB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
