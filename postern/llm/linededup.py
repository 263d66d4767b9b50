"""Line dedup by content-defined chunks.

A text is cut into lines; a rolling hash over the hashes of a line and the one before it chooses where a chunk ends, so
boundaries depend on content alone and shift with it. A line of ``LONG`` words or more is a passage by itself: a boundary
stands before and after it. Chunks of several lines, and passages, that occur again anywhere are removed but for their
first occurrence (least doc_id, then position), after their bytes, not only their hashes, are found equal.

Hashes are counted first, with partial sums, and only chunks whose hash repeats travel with their bytes. Grouping by the
bytes is the comparison; it is pre-aggregated too, so a chunk that a third of all documents share travels once a task.

Chunk boundaries next to a passage depend on what surrounds it, so a short passage of several lines may lie in no chunk of
its own. dedup_passages() finds these whatever surrounds them, by windows: see there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.llm.common import filter_of, flagged, long, map_texts, passes, string, unwrap, wrap
from postern.shared import cut, scratch

#: A chunk ends where the rolling hash is 0 modulo this; words of a line that is a passage by itself.
MODULUS, LONG = 3, 50



def is_long(line: bytes, least: int = LONG) -> bool:
    return len(line) >= 2 * least - 1 and len(line.split(None, least - 1)) == least


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def chunks_of(text: bytes | None) -> list[tuple[int, int, bool]]:
    """(first line, line after the last, may be removed) of each chunk. A null text has none, an empty one a single empty line."""
    if text is None:
        return []
    lines = text.split(b"\n")
    out, start, before = [], 0, 0
    for k, line in enumerate(lines):
        passage = is_long(line)
        if passage and k > start:
            out.append((start, k, k - start > 1))
            start = k
        now = line_hash(line)
        if passage or (before * 31 + now) % MODULUS == 0 or k == len(lines) - 1:
            out.append((start, k + 1, passage or k + 1 - start > 1))
            start = k + 1
        before = now
    return out


def bytes_of(lines: list[bytes], lo: int, hi: int) -> bytes:
    return b"\n".join(lines[lo:hi])


def _hash(chunk: bytes) -> int:
    return int.from_bytes(hashlib.md5(chunk).digest()[:8], "big", signed=True)


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document (doc_id and hash of its text) with removals: gone, the sorted first lines of the chunks to remove."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")).where(F.col("text").contains("\n") | (F.length("text") >= 2 * LONG - 1))

    def hashes():
        def fn(texts):
            out = []
            for t in texts:
                lines = t.split(b"\n")
                out.append([_hash(bytes_of(lines, lo, hi)) for lo, hi, ok in chunks_of(t) if ok])
            return [out]

        return fn

    seen = map_texts(rows, hashes, [T.StructField("h", T.ArrayType(T.LongType()))], keep=[]).select(F.explode("h").alias("h"))
    often = cut(seen.groupBy("h").count().where("count > 1").select("h"))
    packed = filter_of(often, "h")  # keeps most other chunks out of the shuffle

    piece = T.StructType([long("h"), long("line"), T.StructField("chunk", T.BinaryType())])

    def pieces():
        def fn(texts):
            out = []
            for t in texts:
                lines = t.split(b"\n")
                made = [(lo, bytes_of(lines, lo, hi)) for lo, hi, ok in chunks_of(t) if ok]
                h = [_hash(c) for _, c in made]
                out.append([{"h": x, "line": lo, "chunk": c} for x, (lo, c), ok in zip(h, made, passes(packed.value, h), strict=True) if ok])
            return [out]

        return fn

    at = map_texts(rows, pieces, [T.StructField("p", T.ArrayType(piece))], keep=["doc_id", "text_hash"], slice_rows=64).select("doc_id", "text_hash", F.inline("p"))
    found = cut(at.join(often, "h", "left_semi"))
    first = F.min(F.struct("doc_id", "line", "text_hash")).alias("first")
    # written, so that the join deals its rows by itself and adaptive execution can split a hot chunk
    kept = cut(found.groupBy("h", "chunk").agg(first, F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("same_h"), F.col("chunk").alias("same"), "first"))
    gone = found.join(kept, (F.col("h") == F.col("same_h")) & (F.col("chunk") == F.col("same"))).where(~F.struct("doc_id", "line", "text_hash").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("gone"))


REPORT = [long("n_lines"), long("n_chunks"), long("n_removed"), long("lines_removed"), string("clean_text")]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_chunks, n_removed (chunks), lines_removed and clean_text.

    Lines end at ``\\n``. A null text has no lines and stays null; an empty one has one empty line. A text whose chunks all
    go becomes empty. Rows equal in id and text are one occurrence: they keep or lose the same chunks.
    """
    with scratch(docs.sparkSession) as stays:
        gone = cut(repeated_chunks(docs, doc_id, text))
        stays.append(gone)
    packed = filter_of(gone.select(F.xxhash64("doc_id", "text_hash").alias("h")), "h")
    names = [c for c in docs.columns if c.lower() not in {f.name for f in REPORT}]
    rows = wrap(docs, [c for c in names if c != text], doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))
    rows = flagged(rows, F.xxhash64("doc_id", "text_hash"), packed)
    right = gone.withColumnsRenamed({"doc_id": "gone_id", "text_hash": "gone_hash"})
    # texts that lose nothing are not shuffled
    met = rows.where("flag_").join(right, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    joined = met.select("row_", "text", "gone").union(rows.where("not flag_").select("row_", "text", F.lit(None).cast("array<bigint>").alias("gone")))

    def make():
        def fn(texts, marks):
            out = []
            for t, lost in zip(texts, marks, strict=True):
                if t is None:
                    out.append((0, 0, 0, 0, None))
                    continue
                lines = t.split(b"\n")
                chunks = chunks_of(t)
                lost = set(lost or ())
                stay = [(lo, hi) for lo, hi, _ in chunks if lo not in lost]
                clean = t if not lost else b"\n".join(lines[k] for lo, hi in stay for k in range(lo, hi))
                out.append((len(lines), len(chunks), len(chunks) - len(stay), len(lines) - sum(hi - lo for lo, hi in stay), clean.decode()))
            return [list(c) for c in zip(*out, strict=True)] or [[]] * 5

        return fn

    done = map_texts(joined, make, REPORT, ["text", "gone"], keep=["row_", "text"])
    return done.select(*unwrap(names, text=text), *[f.name for f in REPORT])


def windows_of(lines: list[bytes], least: int = LONG) -> list[tuple[int, int]]:
    """From each line the fewest lines onwards, and the fewest lines back, that hold ``least`` words: (first line, line after the last).

    Any run of adjacent lines with ``least`` words or more is the union of the windows inside it.
    """
    total = np.cumsum([0, *(len(x.split()) for x in lines)])
    at = np.arange(len(lines))
    ends = np.searchsorted(total, total[:-1] + least)
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    ahead, back = ends <= len(lines), starts >= 0
    return sorted({*zip(at[ahead].tolist(), ends[ahead].tolist(), strict=True), *zip(starts[back].tolist(), (at[back] + 1).tolist(), strict=True)})


def _window_hashes(text: bytes) -> list[tuple[int, int, int, int]]:
    """(first line, line after the last, two halves of a 128-bit hash) of each window."""
    lines = text.split(b"\n")
    begin = np.cumsum([0, *(len(x) + 1 for x in lines)]).tolist()
    view = memoryview(text)
    return [(lo, hi, *np.frombuffer(xxhash.xxh3_128_digest(view[begin[lo] : begin[hi] - 1]), np.int64).tolist()) for lo, hi in windows_of(lines)]


PASSAGES = [long("passage_lines_removed"), string("clean_text")]


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with passage_lines_removed and clean_text: every repeated run of lines of ``LONG`` words or more goes but for its first occurrence.

    A window of lines that occurs again anywhere (128-bit hashes) keeps its first occurrence (least doc_id, then line, then
    text) whole; lines of its other occurrences go unless they lie in a first occurrence of another repeated window. Null
    texts stay null. Rows equal in id and text are one occurrence.
    """
    names = [c for c in docs.columns if c.lower() not in {f.name for f in PASSAGES}]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")).where(F.length("text") >= 2 * LONG - 1)

    def hashes():
        return lambda texts: [[[h for *_, h in _window_hashes(t)] for t in texts]]

    with scratch(docs.sparkSession) as stays:
        seen = map_texts(rows, hashes, [T.StructField("h", T.ArrayType(T.LongType()))], keep=[]).select(F.explode("h").alias("h"))
        packed = filter_of(cut(seen.groupBy("h").count().where("count > 1").select("h")), "h")
        piece = T.StructType([long("lo"), long("hi"), long("g"), long("h")])

        def pieces():
            def fn(texts):
                out = []
                for t in texts:
                    made = _window_hashes(t)
                    out.append([dict(zip(("lo", "hi", "g", "h"), x, strict=True)) for x, ok in zip(made, passes(packed.value, [x[3] for x in made]), strict=True) if ok])
                return [out]

            return fn

        found = cut(map_texts(rows, pieces, [T.StructField("p", T.ArrayType(piece))], keep=["doc_id", "text_hash"], slice_rows=64).select("doc_id", "text_hash", F.inline("p")))
        place = F.struct("doc_id", "lo", "text_hash")
        again = cut(found.groupBy("g", "h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("g").alias("same_g"), F.col("h").alias("same_h"), "first"))
        marks = found.join(again, (F.col("g") == F.col("same_g")) & (F.col("h") == F.col("same_h")))
        marks = marks.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi", place.eqNullSafe(F.col("first")).alias("stays"))).alias("marks"))
        marks = cut(marks.where(F.exists("marks", lambda m: ~m["stays"])))
        stays.append(marks)
    met = filter_of(marks.select(F.xxhash64("doc_id", "text_hash").alias("h")), "h")
    all_rows = wrap(docs, [c for c in names if c != text], doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text"))
    all_rows = flagged(all_rows, F.xxhash64("doc_id", "text_hash"), met)
    right = marks.withColumnsRenamed({"doc_id": "mark_id", "text_hash": "mark_hash"})
    touched = all_rows.where("flag_").join(right, F.col("doc_id").eqNullSafe(F.col("mark_id")) & (F.col("text_hash") == F.col("mark_hash")), "left")
    joined = touched.select("row_", "text", "marks").union(all_rows.where("not flag_").select("row_", "text", F.lit(None).cast(right.schema["marks"].dataType).alias("marks")))

    def make():
        def fn(texts, marks):
            out = []
            for t, found in zip(texts, marks, strict=True):
                if t is None or not found:
                    out.append((0, None if t is None else t.decode()))
                    continue
                lines = t.split(b"\n")
                gone, stay = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
                for m in found:
                    (stay if m["stays"] else gone)[m["lo"] : m["hi"]] = True
                gone &= ~stay
                out.append((int(gone.sum()), b"\n".join(x for x, lost in zip(lines, gone, strict=True) if not lost).decode()))
            return [list(c) for c in zip(*out, strict=True)] or [[]] * 2

        return fn

    done = map_texts(joined, make, PASSAGES, ["text", "marks"], keep=["row_", "text"])
    return done.select(*unwrap(names, text=text), *[f.name for f in PASSAGES])


def digest(docs: DataFrame) -> DataFrame:
    """Per document: n_lines, n_chunks, n_removed, lines_removed and the hash of what stays."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_chunks", "n_removed", "lines_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


#: DuckDB: the same boundaries from md5 hashes, chunks compared as strings.
SQL = r"""
WITH d AS (SELECT doc_id, text, md5(text) AS th, row_number() OVER () AS r FROM documents),
l AS (
  SELECT r, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line, len(ls) AS n
  FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL)
), m AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS big FROM l
), e AS (
  SELECT *, big OR (coalesce(lag(h) OVER w, 0) * 31 + h) % 3 = 0 OR coalesce(lead(big) OVER w, true) AS last FROM m WINDOW w AS (PARTITION BY r ORDER BY k)
), g AS (
  SELECT *, coalesce(sum(CAST(last AS INTEGER)) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e
), ch AS (
  SELECT r, c, min(k) AS k, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS chunk, bool_or(big) OR count(*) > 1 AS ok FROM g GROUP BY r, c
), occ AS (SELECT ch.*, d.doc_id, d.th FROM ch JOIN d USING (r)),
firsts AS (
  SELECT chunk, min({'i': doc_id, 'k': k, 't': th}) AS first FROM occ WHERE ok GROUP BY chunk
), marked AS (
  SELECT occ.*, ok AND {'i': doc_id, 'k': k, 't': th} <> first AS gone FROM occ LEFT JOIN firsts USING (chunk)
), s AS (
  SELECT r, sum(n) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed, coalesce(sum(n) FILTER (gone), 0) AS lines_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT coalesce(gone, false)), '') AS clean
  FROM marked GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(lines_removed, 0) AS BIGINT) AS lines_removed, sha256(clean) AS clean_sha256
FROM d LEFT JOIN s USING (r)
"""
