"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

Items and documents are lower-cased (A-Z) and cut into words of ASCII letters, digits and all characters from U+0080 on.
The automaton accepts every run of consecutive item words; a document is streamed through it word by word, which gives the
longest match that ends at each word. Matches of ``window`` words or more, and whole items that are shorter, are hits.

Executors build the automaton; it is broadcast only up to about ``shard_words`` words. A larger benchmark is cut into shards of
that size, which lie in the shared folder and pass the driver one at a time. Documents are then read once, with a filter of
fixed size over the hashes of all item windows; only those that the filter passes meet the shards, one after another, so no
worker ever holds more than one.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.llm.common import boolean, filter_of, long, map_texts, passes, rolled, string, unwrap, word_hashes, wrap
from postern.shared import cut, forget

WINDOW = 10
SHARD_WORDS = 200_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton over the word sequences of several items."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        self.short: dict[int, set[tuple[int, str]]] = {}
        self.least = window
        seqs = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for i, words in items if words]
        for _, seq in seqs:
            at = 0
            for x in seq:
                at = self._extend(at, x)
        self.items: dict[int, set[str]] = {}  # of states that stand for a whole window
        for item, seq in seqs:
            at = 0
            for x in seq:
                at = self.next[at][x]
                up = at
                while self.length[up] >= window and item not in self.items.setdefault(up, set()):
                    self.items[up].add(item)
                    up = self.link[up]
            if len(seq) < window:
                self.short.setdefault(at, set()).add((len(seq), item))
                self.least = min(self.least, len(seq))

    def _extend(self, last: int, x: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        q = nxt[last].get(x)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, x, q)
        cur = self._state(length[last] + 1, 0, {})
        p = last
        while p != -1 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][x]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
        return cur

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _clone(self, p: int, x: int, q: int) -> int:
        made = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(x) == q:
            self.next[p][x] = made
            p = self.link[p]
        self.link[q] = made
        return made

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged half-open word ranges that are hit, and the items whose windows occur there."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= self.least  # no match crosses a word that no item has
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for lo, hi in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            self._run(ids[lo:hi].tolist(), lo, spans, found)
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        return merged, found

    def _run(self, ids: list[int], base: int, spans: list, found: set[str]) -> None:
        nxt, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        state = size = 0
        for i, x in enumerate(ids):
            to = nxt[state].get(x)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(x)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= window:
                if spans and spans[-1][1] == base + i and spans[-1][0] >= base + i + 1 - size:
                    spans.pop()
                spans.append((base + i + 1 - size, base + i + 1))
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                found |= self.items[up]
            if short:
                up = state
                while up > 0:
                    for n, item in short.get(up, ()):
                        if n <= size:
                            spans.append((base + i + 1 - n, base + i + 1))
                            found.add(item)
                    up = link[up]


def pieces_of(words: list[bytes], window: int, most: int) -> list[list[bytes]]:
    """A long item in pieces of at most ``most`` words that overlap by a window less one word: each window lies in a piece."""
    most = max(most, 2 * window)
    out, at = [], 0
    while len(words) - at > most:
        out.append(words[at : at + most])
        at += most - window + 1
    return [*out, words[at:]]


def item_pieces(items: DataFrame, window: int, shard_words: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n, words) of each piece: its number of words, and the words joined by blanks. Null ids and texts without words take no part."""
    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("item is not null and text is not null")
    piece = T.StructType([long("n"), T.StructField("words", T.BinaryType())])

    def make():
        return lambda texts: [[[{"n": len(p), "words": b" ".join(p)} for p in pieces_of(words_of(t), window, shard_words) if p] for t in texts]]

    return map_texts(rows, make, [T.StructField("p", T.ArrayType(piece))], keep=["item"]).select("item", F.inline("p"))


def window_hashes(words: list[bytes], sizes: Sequence[int]) -> np.ndarray:
    h = word_hashes(words) if words else np.empty(0, np.uint64)
    return np.unique(np.concatenate([rolled(h, n) for n in sizes] or [h])).view(np.int64)


def build(pieces: DataFrame, window: int, n_shards: int) -> DataFrame:
    """(shard, automaton) in the shared folder: pieces dealt by hash, one automaton built by a task at a time."""
    rows = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(n_shards)))
    dealt = rows.select("shard", "item", "words").repartition(n_shards, "shard").sortWithinPartitions("shard", "item", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def drain() -> pa.RecordBatch:
            made = pickle.dumps(Automaton(held, window), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([made], pa.binary())], names=["shard", "automaton"])

        for batch in batches:
            for shard, item, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if held:
                        yield drain()
                    at, held = shard, []
                held.append((item, words.split()))
        if held:
            yield drain()

    return cut(dealt.mapInArrow(run, T.StructType([long("shard"), T.StructField("automaton", T.BinaryType())])))


def mark_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", keep: Sequence[str] | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with n_words, hit_ranges (merged word ranges, flat: start, end, ...) and hit_items (sorted item ids).

    Null and empty texts have no words and no hits; an empty benchmark hits nothing. Items of fewer words than ``window``
    count as one window. Repeated items count once by id.
    """
    sc = docs.sparkSession.sparkContext
    fields = [long("n_words"), T.StructField("hit_ranges", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    cols = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in fields}]
    pieces = cut(item_pieces(items, window, shard_words))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n_shards = -(-total // shard_words)
    if n_shards <= 1:
        built = build(pieces, window, 1)
        made = [bytes(r.automaton) for r in built.collect()] or [pickle.dumps(Automaton([], window))]  # at most one
        forget(built)
        forget(pieces)
        return map_texts(docs, _scanning(sc.broadcast(made[0]), True), fields, text, keep=cols)
    # a larger benchmark: one read of the documents chooses those that a window may lie in
    sizes = [r.n for r in pieces.select(F.least("n", F.lit(window)).alias("n")).distinct().collect()]  # at most ``window``

    def hashes():
        return lambda words: [[window_hashes(w.split(), [min(window, len(w.split()))]).tolist() for w in words]]

    packed = filter_of(map_texts(pieces, hashes, [T.StructField("h", T.ArrayType(T.LongType()))], "words", keep=[]).select(F.explode("h").alias("h")), "h")

    def first():
        def fn(texts):
            words = [words_of(t) for t in texts]
            return [[len(w) for w in words], [[] for _ in words], [[] for _ in words], [bool(passes(packed.value, window_hashes(w, sizes)).any()) for w in words]]

        return fn

    seen = cut(map_texts(docs, first, [*fields, boolean("maybe_")], text, keep=list(dict.fromkeys([*cols, text]))))
    found = seen.where("maybe_").drop("maybe_")
    for row in build(pieces, window, n_shards).toLocalIterator():
        shared = sc.broadcast(bytes(row.automaton))
        found = cut(map_texts(found, _scanning(shared, False), fields, [text, "hit_ranges", "hit_items"], keep=list(dict.fromkeys([*cols, text]))))
        shared.unpersist()
    names = [*cols, *[f.name for f in fields]]
    return found.select(*[f"`{c}`" for c in names]).union(seen.where("not maybe_").select(*[f"`{c}`" for c in names]))


def _scanning(shared, alone: bool):
    def make():
        automaton = pickle.loads(shared.value)

        def fn(texts, *before):
            n, ranges, found = [], [], []
            for j, t in enumerate(texts):
                words = words_of(t)
                spans, hit = automaton.scan(words) if words else ([], set())
                if not alone:
                    old = before[0][j]
                    spans = union([*spans, *zip(old[::2], old[1::2], strict=True)])
                    hit = hit | set(before[1][j])
                n.append(len(words))
                ranges.append([x for s in spans for x in s])
                found.append(sorted(hit))
            return [n, ranges, found]

        return fn

    return make


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def remove_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.8, text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the passages of the benchmark: hit spans are cut out of the text, and a document of which more than
    ``max_coverage`` of the words is hit goes as a whole. Other texts, null and empty ones too, pass unchanged.
    """
    names = docs.columns
    docs = wrap(docs, [c for c in names if c != text], text=text)
    marked = mark_overlaps(docs, items, window, shard_words=shard_words)

    def make():
        def fn(texts, ranges, ns):
            out, drop = [], []
            for t, flat, n in zip(texts, ranges, ns, strict=True):
                hit = sum(flat[1::2]) - sum(flat[::2])
                drop.append(bool(n) and hit > max_coverage * n)
                if flat and not drop[-1]:
                    at = [m.span() for m in _WORD.finditer(t)]
                    pieces, end = [], 0
                    for lo, hi in zip(flat[::2], flat[1::2], strict=True):
                        pieces.append(t[end : at[lo][0]])
                        end = at[hi - 1][1]
                    t = b"".join([*pieces, t[end:]])
                out.append(None if t is None else t.decode())
            return [out, drop]

        return fn

    cleaned = map_texts(marked, make, [string("cleaned"), boolean("dropped")], ["text", "hit_ranges", "n_words"], keep=["row_"])
    return cleaned.where("not dropped").select(*unwrap(names, cleaned=text))


def digest(marked: DataFrame) -> DataFrame:
    """The contract's columns from mark_overlaps()."""
    hit = F.aggregate(F.transform(F.col("hit_ranges"), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return marked.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def sha256_of(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


#: DuckDB: the same windows by joins of joined words.
SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT r, k, dw.n, item FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
