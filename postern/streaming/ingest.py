"""Structured Streaming on top of the batch engine: files as they arrive, and event windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.limits import Limits
from postern.operators import corpus, parse
from postern.shared import exists, new_path
from postern.sources import messages


FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, path: str, store: str, checkpoint: str, limits: Limits | None = None) -> None:
    """Parse what is new below ``path`` into the Parquet ``store``, then return.

    A file seen before is not read again, and bytes that the store holds are not parsed again, whatever file they come in.
    Each file leaves a row in ``store``/outcomes: parse, hit (held already), not_a_message or file_over_cap. Messages are in ``store``/messages.
    """
    limits = limits or Limits()
    kept, outcomes = f"{store}/messages", f"{store}/outcomes"
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)

    def add(batch: DataFrame, number: int) -> None:
        over = F.col("length") > limits.max_input_bytes
        rows = batch.select("path", F.col("length").alias("size_bytes"), F.when(~over, F.col("content")).alias("raw"))
        keyed = messages.gated(rows, limits).withColumn("container_hash", F.sha2("raw", 256)).withColumn("document_key", corpus.document_key(F.col("container_hash"), limits))
        if exists(spark, kept):
            keyed = keyed.join(spark.read.parquet(kept).select("document_key", F.lit(True).alias("held")), "document_key", "left")
        else:
            keyed = keyed.withColumn("held", F.lit(False))
        keyed = keyed.withColumn("outcome", F.when((F.col("outcome") == "parse") & F.coalesce("held", F.lit(False)), "hit").otherwise(F.col("outcome")))
        # first, as a batch that is run again would find its own messages held
        keyed.select("path", "size_bytes", "outcome", "document_key").write.mode("overwrite").parquet(f"{outcomes}/batch={number}")
        new = keyed.where("outcome = 'parse'").dropDuplicates(["document_key"]).select("path", "document_key", "raw")
        parse.parse_messages(new).write.mode("append").parquet(kept)

    files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windows(events: DataFrame, time: str, group: str, size: str, late: str) -> DataFrame:
    """(window_start, window_end, group, n): tumbling counts. State is dropped, and a window emitted, once the watermark passes its end."""
    counted = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size).alias("w"), group).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), group, "n")


def closed_windows(spark: SparkSession, directory: str, file: str, time: str, group: str, size: str, late: str) -> DataFrame:
    """windows() over a file read as a stream, up to the last window that is closed."""
    schema = spark.read.parquet(f"{directory}/{file}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(directory)
    home = new_path(spark)
    made = windows(events, time, group, size, late)
    made.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(made.schema).parquet(f"{home}/out")
    kind = schema[time].dataType  # times without a zone stay so
    return out.select(F.col("window_start").cast(kind).alias("window_start"), F.col("window_end").cast(kind).alias("window_end"), group, "n")
