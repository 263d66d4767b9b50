"""Hierarchical packing of tokenised documents into windows of several context sizes.

A document is its ids and one end id. Its whole windows of the longest tier are sequences at once; what remains is routed
to the tier of the next power of two. The long tier packs first: each window opens with the largest remainder, takes the
largest remainders of the shorter tiers that fit into its gap, and closes the last gap with a cut from the smallest
remainder that is too long. Shorter tiers follow in the same way, so all windows are full; the few pieces that cannot fill
a window at the end of a block become shorter sequences at powers of two. Sequences are dealt into step groups of equal
token counts.

Packing runs within a task, block by block: memory is bounded by ``BLOCK`` tokens and nothing is shuffled. The rows of a
task decide its sequences, so their numbers depend on how the table is split, but every id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postern.llm.common import long
from postern.llm.tokens import Ids

WINDOW = 1024
LEAST = 128
END_ID = 0
#: Tokens that a task packs together, and tokens of a step group.
BLOCK = 1 << 20
STEP = 1 << 14


def tier_of(n: int, window: int = WINDOW, least: int = LEAST) -> int:
    return min(window, max(least, 1 << (n - 1).bit_length()))


class Packer:
    """Packs remainders, given as (document, start, length), into sequences: lists of pieces."""

    def __init__(self, window: int = WINDOW, least: int = LEAST):
        self.window, self.least = window, least

    def pack(self, rests: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        by_size: list[list[tuple[int, int, int]]] = [[] for _ in range(self.window + 1)]
        there = 0  # bit n: there is a remainder of n ids
        for r in rests:
            by_size[r[2]].append(r)
            there |= 1 << r[2]
        out: list[list[tuple[int, int, int]]] = []

        def take(n: int) -> tuple[int, int, int]:
            nonlocal there
            got = by_size[n].pop()
            if not by_size[n]:
                there &= ~(1 << n)
            return got

        while there:
            first = take(there.bit_length() - 1)
            size = tier_of(first[2], self.window, self.least)
            pieces, gap = [first], size - first[2]
            while gap and there:
                if fit := (there & ((2 << gap) - 1)).bit_length():
                    pieces.append(take(fit - 1))
                    gap -= pieces[-1][2]
                    continue
                least = (there & -there).bit_length() - 1
                doc, start, n = take(least)
                pieces.append((doc, start, gap))
                by_size[n - gap].append((doc, start + gap, n - gap))
                there |= 1 << (n - gap)
                gap = 0
            if not gap:
                out.append(pieces)
                continue
            for doc, start, n in pieces:  # the last pieces of a block: powers of two, without padding
                while n:
                    part = 1 << (n.bit_length() - 1)
                    out.append([(doc, start, part)])
                    start, n = start + part, n - part
        return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, tier, step_group (and ids).

    A null or empty text is a document of the end id alone. Repeated rows are documents of their own. Other columns do not pass.
    ``window`` is a power of two, at least 128.
    """
    source = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    fields = [long(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "tier", "step_group")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        ids_of, packer = Ids(tokenizer), Packer(window)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        done = 0
        names: list[int | None] = []
        bodies: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            sequences, rests = [], []
            for k, ids in enumerate(bodies):
                whole = len(ids) // window * window
                sequences += [[(k, at, window)] for at in range(0, whole, window)]
                if whole < len(ids):
                    rests.append((k, whole, len(ids) - whole))
            sequences += packer.pack(rests)
            lengths = [sum(p[2] for p in s) for s in sequences]
            steps, filled = {}, 0
            for k in sorted(range(len(sequences)), key=lambda k: -lengths[k]):  # powers of two, largest first: steps fill exactly
                steps[k] = base + (done + filled // max(STEP, window))
                filled += lengths[k]
            cols: list[list] = [[] for _ in fields]
            for k, s in enumerate(sequences):
                offset = 0
                for doc, start, n in s:
                    body = bodies[doc][start : start + n]
                    row = (names[doc], start, n, zlib.crc32(body.astype("<u4").tobytes()), len(bodies[doc]), base + done + k, offset, lengths[k], tier_of(lengths[k], window), steps[k], *([body.tolist()] if with_ids else []))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += n
            done += max(len(sequences), filled // max(STEP, window) + 1)
            for at in range(0, len(cols[0]), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 8192], t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)
            names.clear()
            bodies.clear()

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for name, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    ids = np.append(ids_of.encode(t), np.uint32(END_ID))
                    names.append(name)
                    bodies.append(ids)
                    held += len(ids)
                    if held >= BLOCK:
                        yield from flush()
                        held = 0
        if bodies:
            yield from flush()

    return source.mapInArrow(run, schema)
