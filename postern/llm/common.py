"""Shared plumbing of the training-data operators.

Conventions that hold for every operator of this subpackage:

* result columns replace input columns of the same name, compared without case as Spark does; all other input columns pass through;
* null and empty texts never fail; each operator states what they give;
* rows are never matched by position, so repeated rows give repeated, equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python worker turns into objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns that a result of these names replaces."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


def wrap(df: DataFrame, names: Sequence[str], **columns: str) -> DataFrame:
    """``df`` with the columns ``names`` in one struct, row_, so that they clash with no name of an operator's own, and some columns under new names."""
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("none"))
    return df.select(row.alias("row_"), *[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def unwrap(names: Sequence[str], **columns: str) -> list[Column]:
    """The columns ``names`` from row_; ``columns`` says which come from elsewhere: new name, name."""
    there = {c: k for k, c in columns.items()}
    return [(F.col(there[c]) if c in there else F.col("row_").getField(c)).alias(c) for c in names]


M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` neighbours."""
    count = max(0, len(h) - n + 1)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = mix(out * M1 + h[k : k + count])
    return out


#: Bits of a membership filter: its size is fixed, whatever it holds; where it is full it passes everything, and the exact join that follows decides.
FILTER_BITS = 1 << 26


def slot_of(column: Column) -> Column:
    """Place of a 64-bit hash in a membership filter."""
    return column.bitwiseAND(F.lit(FILTER_BITS - 1))


def filter_of(hashes: DataFrame, column: str) -> Broadcast:
    """A filter over a column of 64-bit hashes, built by executors in blocks of 4 KB and broadcast as one array of 8 MB."""
    slot = slot_of(F.col(column))
    blocks = hashes.groupBy(F.shiftright(slot, 15).alias("block")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
    packed = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in blocks.collect():  # at most 2048 blocks
        packed[r.block << 12 : (r.block + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(packed)


def passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = np.asarray(hashes, np.int64) & (FILTER_BITS - 1)
    return (packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def flagged(df: DataFrame, hashed: Column, packed: Broadcast) -> DataFrame:
    """``df`` with ``flag_``: whether the filter passes the row's hash."""

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(passes(packed.value, h.to_numpy(np.int64)))

    return df.withColumn("flag_", test(hashed))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list[list]]], fields: Sequence[T.StructField], text: str | Sequence[str] = "text", keep: Sequence[str] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Append columns computed from text columns, a slice of rows at a time, in Arrow batches.

    ``make()`` runs once per task and returns ``fn(texts, ...) -> [column, ...]``, one list for each of ``fields``;
    texts arrive as UTF-8 ``bytes`` or None (columns of other types as Python values). ``keep`` names the input columns that pass through (default: all).
    """
    texts = [text] if isinstance(text, str) else list(text)
    low = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in low]
    need = list(dict.fromkeys([*kept, *texts]))
    source = df.select(*[f"`{c}`" for c in need])
    by_name = {f.name: f for f in source.schema.fields}
    out = T.StructType([by_name[c] for c in kept] + list(fields))
    at_text, at_kept = [need.index(t) for t in texts], [need.index(c) for c in kept]
    as_bytes = [isinstance(by_name[t].dataType, T.StringType) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fn = make()
        schema = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                args = [(c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()) if b else c).to_pylist() for c, b in ((part.column(i), b) for i, b in zip(at_text, as_bytes, strict=True))]
                made = fn(*args)
                new = [v if isinstance(v, pa.Array) else pa.array(v, schema.field(len(kept) + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays([part.column(i).cast(schema.field(k).type) for k, i in enumerate(at_kept)] + new, schema=schema)

    return source.mapInArrow(run, out)


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())
