"""Language identification with string kernels.

The kernel is the blended spectrum of byte n-grams (1 to 3) with presence features, k(x, y) = |x & y| / sqrt(|x| |y|), over
the n-grams of the landmarks. Nystroem landmarks map a text to k(x, landmarks) K_mm^(-1/2); kernel ridge regression, one
language against the rest, is solved there. As the kernel is linear in presence features, landmarks, whitening and ridge
weights fold into one matrix and a batch is scored by one matrix product. A text is scored whole, in segments of
``SEGMENT`` bytes whose scores are averaged by length. All n-grams of the landmarks take part, however many languages there are.

The fit takes at most ``per_lang`` labelled texts of each language (those of least hash), and segments of them; that bound
is the only sample here.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.llm.common import double, map_texts, string

SEGMENT = 2000
#: Texts of each language that the fit may see, landmarks of each language, and ridge.
PER_LANG, LANDMARKS, RIDGE = 400, 60, 1e-2

_LETTER = re.compile(rb"[A-Za-z]")
_LOW = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return _LETTER.search(text) is not None or (max(text) >= 128 and any(c.isalpha() for c in text.decode(errors="replace")))


def segments_of(text: bytes) -> list[np.ndarray]:
    """Equal segments of at most SEGMENT bytes; they overlap by the two bytes that n-grams across a cut need."""
    codes = np.frombuffer(text.translate(_LOW), np.uint8).astype(np.int32)
    n = -(-len(codes) // SEGMENT)
    size = -(-len(codes) // n)
    return [codes[k * size : min(len(codes), (k + 1) * size + 2)] for k in range(n)]


def grams(codes: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams, in disjoint ranges below 2^24 + 2^16 + 2^8."""
    two = codes[:-1] << 8 | codes[1:]
    three = two[:-1] << 8 | codes[2:] if len(codes) > 2 else codes[:0]
    return np.concatenate([three, two + (1 << 24), codes + (1 << 24) + (1 << 16)])


SPACE = (1 << 24) + (1 << 16) + (1 << 8)


class Presence:
    """Presence rows over a fixed set of n-grams."""

    def __init__(self, known: np.ndarray):
        self.width = len(known)
        self.at = np.zeros(SPACE, np.uint16 if len(known) < 65535 else np.int32)
        self.at[known] = np.arange(1, len(known) + 1)

    def rows(self, segments: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(segments), self.width + 1), np.float32)
        for row, s in zip(x, segments, strict=True):
            row[self.at[grams(s)]] = 1
        return x[:, 1:]

    def of(self, segment: np.ndarray) -> np.ndarray:
        """Sorted places of the n-grams of a segment."""
        at = np.unique(self.at[grams(segment)]).astype(np.int32)
        return at[at > 0] - 1


#: N-grams and texts that the fit holds densely at once.
COLUMNS, ROWS = 8192, 1024


def dense(found: list[np.ndarray], lo: int) -> np.ndarray:
    """Presence rows of the n-grams ``lo`` to ``lo + COLUMNS``."""
    x = np.zeros((len(found), COLUMNS), np.float32)
    for row, f in zip(x, found, strict=True):
        a, b = np.searchsorted(f, (lo, lo + COLUMNS))
        row[f[a:b] - lo] = 1
    return x


class Model:
    def __init__(self, langs: list[str], known: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.known, self.weights, self.bias = langs, known, weights, bias

    def scorer(self):
        presence = Presence(self.known) if self.langs else None

        def score(texts: list[bytes | None]) -> tuple[list[str], list[float]]:
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            owners, segments, sums = [], [], np.zeros((len(texts), max(1, len(self.langs))))
            weight = np.zeros(len(texts))

            def flush() -> None:
                if segments:
                    if presence.width <= COLUMNS:
                        x = presence.rows(segments)
                        size = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
                        made = (x @ self.weights) / size + self.bias
                    else:
                        found = [presence.of(s) for s in segments]
                        made = np.array([self.weights[f].sum(axis=0) / np.sqrt(max(len(f), 1)) for f in found]) + self.bias
                    w = np.array([len(s) for s in segments], np.float64)
                    np.add.at(sums, owners, made * w[:, None])
                    np.add.at(weight, owners, w)
                    owners.clear()
                    segments.clear()

            for k, t in enumerate(texts):
                if self.langs and has_letter(t):
                    for s in segments_of(t):
                        owners.append(k)
                        segments.append(s)
                        if len(segments) == 64:
                            flush()
            flush()
            for k in np.flatnonzero(weight):
                mean = sums[k] / weight[k]
                best = int(mean.argmax())
                e = np.exp(4 * (mean - mean[best]))
                langs[k], scores[k] = self.langs[best], float(1 / e.sum())
            return langs, scores

        return score


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``rows``: (lang, text) in a fixed order. Without any labelled text the model knows no language."""
    langs = sorted({lang for lang, _ in rows})
    picked: list[tuple[int, np.ndarray]] = []
    for k, lang in enumerate(langs):
        for name, text in rows:
            if name == lang:
                picked += [(k, s) for s in segments_of(text)]
    if not picked:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0))
    y = np.array([k for k, _ in picked])
    chosen = [i for k in range(len(langs)) for i in np.flatnonzero(y == k)[:landmarks]]
    known = np.unique(np.concatenate([grams(picked[i][1]) for i in chosen]))
    presence = Presence(known)
    found = [presence.of(s) for _, s in picked]
    size = np.sqrt(np.array([max(len(f), 1) for f in found], np.float64))
    # n-grams by blocks of columns, texts by blocks of rows: memory grows with neither
    near = np.zeros((len(found), len(chosen)))
    for lo in range(0, len(known), COLUMNS):
        base = dense([found[i] for i in chosen], lo)
        for at in range(0, len(found), ROWS):
            near[at : at + ROWS] += dense(found[at : at + ROWS], lo) @ base.T
    near /= size[:, None] * size[chosen]
    values, vectors = np.linalg.eigh(near[chosen])
    keep = values > 1e-8 * values.max()
    white = vectors[:, keep] / np.sqrt(values[keep])
    phi = near @ white
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    balance = 1 / np.bincount(y, minlength=len(langs))[y]  # languages count alike
    balance *= len(y) / balance.sum()
    mean = np.average(phi, axis=0, weights=balance)
    middle = np.average(target, axis=0, weights=balance)
    centred = (phi - mean) * balance[:, None]
    ridge_matrix = centred.T @ (phi - mean) + ridge * len(y) * np.eye(phi.shape[1]) / phi.shape[1]
    solved = np.linalg.solve(ridge_matrix, centred.T @ (target - middle))
    folded = (white @ solved) / size[chosen][:, None]
    weights = np.empty((len(known), len(langs)), np.float32)
    for lo in range(0, len(known), COLUMNS):
        base = dense([found[i] for i in chosen], lo)
        weights[lo : lo + COLUMNS] = (base.T @ folded)[: len(known) - lo]
    return Model(langs, known, weights, middle - mean @ solved)


def training_rows(docs: DataFrame, allowed: Column, per_lang: int = PER_LANG) -> list[tuple[str, bytes]]:
    """Two segments, a third and two thirds into the text, of at most ``per_lang`` texts of each language (those of least id hash)."""
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    ranked = rows.select("lang", F.xxhash64("doc_id").alias("h"), "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.3 * per_lang / n + 30 / n))])
    sample = ranked.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))

    def make():
        def fn(texts):
            parts = [segments_of(t) for t in texts]
            return [[[p[k].astype(np.uint8).tobytes() for k in sorted({len(p) // 3, 2 * len(p) // 3})] for p in parts]]

        return fn

    drawn = map_texts(sample, make, [T.StructField("parts", T.ArrayType(T.BinaryType()))], keep=["lang", "h"]).collect()
    out: list[tuple[str, bytes]] = []
    for lang in sorted(counts):
        mine = sorted({(r.h, *map(bytes, r.parts)) for r in drawn if r.lang == lang})[:per_lang]
        out += [(lang, part) for _, *parts in mine for part in parts]
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1). Texts that are null, empty or without a letter give ``und`` and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.scorer()
        return lambda texts: list(score(texts))

    return map_texts(docs, make, [string("lang_pred"), double("score")], text, keep=keep)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the two thirds that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(training_rows(docs, ~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(rows, model, keep=["doc_id", "held_out"])
