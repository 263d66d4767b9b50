"""Toxicity as an ordinal: a cumulative-link (proportional odds) regression over word presence.

Grades are 0 (clean), 1 (toxic) and 2 (toxic and of low quality). P(grade > k) = sigmoid(w x - t_k) with one weight vector
and ordered thresholds; the score is the expected severity, the sum over k. Features are words and word beginnings with enough support and a
significant link to the grade, so that chance words of long texts carry no weight; the ``FEATURES`` strongest are taken.

The fit takes about ``max_rows`` labelled documents (those of least hash; twice as many at most), one row of each id; word
counts of that sample are gathered by executors, the model is a few hundred words.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.llm.common import boolean, double, long, map_texts
from postern.llm.decontaminate import words_of
from postern.llm.neardup import shingles_of
from postern.shared import cut, forget

#: Labelled documents of a fit, least documents of a feature, least chi-square, least share of toxic texts among a feature's, most features.
MAX_ROWS, SUPPORT, CHI, SHARE, FEATURES = 12_000, 8, 32.0, 0.97, 512


#: Bytes of the word beginnings that are features too.
HEADS = (5, 6, 7, 8)


def features_of(text: bytes | None) -> set[bytes]:
    """Distinct words, and distinct beginnings of longer words, marked with ``^``."""
    words = set(words_of(text))
    heads = {w[:k] for w in words if len(w) > HEADS[0] for k in HEADS if len(w) > k}
    return words | {b"^" + h for h in heads}


def distinct_stems(features: list[bytes]) -> list[bytes]:
    """In the order given (strongest first), without a feature that begins another that is kept, or is begun by one."""
    kept: list[bytes] = []
    for f in features:
        stem = f.removeprefix(b"^")
        if not any(stem.startswith(k.removeprefix(b"^")) or (f != stem and k.removeprefix(b"^").startswith(stem)) for k in kept if f != stem or k[:1] == b"^"):
            kept.append(f)
    return kept


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Model:
    def __init__(self, words: list[bytes], weights: np.ndarray, thresholds: np.ndarray, reject: float = 0.5):
        self.words, self.weights, self.thresholds, self.reject = words, weights, thresholds, reject

    def scorer(self):
        weight = dict(zip(self.words, self.weights.tolist(), strict=True))
        known = weight.keys()
        cuts = self.thresholds

        def score(texts: list[bytes | None]) -> tuple[list[float], list[int]]:
            z = np.array([sum(weight[w] for w in sorted(known & features_of(t))) for t in texts], np.float64)
            above = sigmoid(z[:, None] - cuts[None, :])
            edge = np.hstack([np.ones((len(z), 1)), above, np.zeros((len(z), 1))])
            return above.sum(axis=1).tolist(), np.argmax(edge[:, :-1] - edge[:, 1:], axis=1).tolist()

        return score


def fit(rows: list[tuple[int, list[int]]], words: list[bytes], l2: float = 1e-4, steps: int = 600) -> Model:
    """``rows``: (grade, indexes of its words). Grades without rows get no threshold of their own below them."""
    top = max([g for g, _ in rows], default=0)
    if not rows or top == 0:
        return Model([], np.zeros(0), np.array([30.0]))
    y = np.array([g for g, _ in rows])
    x = np.zeros((len(rows), len(words)), np.float32)
    for k, (_, at) in enumerate(rows):
        x[k, at] = 1
    cuts = np.array([np.log((y <= k).sum() + 1) - np.log((y > k).sum() + 1) for k in range(top)])
    # thresholds as a first value and positive gaps, so that they stay ordered
    params = np.concatenate([[cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2)), np.zeros(len(words))])
    m = v = np.zeros_like(params)
    for step in range(1, steps + 1):
        gaps = np.exp(params[1:top])
        t = params[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x @ params[top:]
        low = np.concatenate([[-np.inf], t])[y]
        high = np.concatenate([t, [np.inf]])[y]
        a, b = sigmoid(high - z), sigmoid(low - z)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        dz = (da - db) / p / len(y)
        dt = np.array([-(da / p)[y == k].sum() + (db / p)[y == k + 1].sum() for k in range(top)]) / len(y)
        grad = np.concatenate([[dt.sum()], [dt[k:].sum() * gaps[k - 1] for k in range(1, top)], x.T @ dz + l2 * params[top:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = params[0] + np.concatenate([[0.0], np.cumsum(np.exp(params[1:top]))])
    severity = sigmoid((x @ params[top:])[:, None] - t[None, :]).sum(axis=1)
    return Model(words, params[top:], t, best_cut(severity, y > 0))


def best_cut(severity: np.ndarray, bad: np.ndarray) -> float:
    """The expected severity from which rejecting gives the best F0.5 on the fitted rows; it lies midway between two of their values."""
    values = np.unique(severity)
    if len(values) < 2:
        return 0.5
    cuts = (values[1:] + values[:-1]) / 2
    order = np.sort(severity)
    at = np.sort(severity[bad])
    caught = len(at) - np.searchsorted(at, cuts)
    taken = len(order) - np.searchsorted(order, cuts)
    return float(cuts[np.argmax(1.25 * caught / np.maximum(taken + 0.25 * len(at), 1))])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents. Null labels and labels without a document take no part; a document labelled twice counts with its highest grade."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, F.when(F.coalesce("quality", F.lit(1)) > 0, 1).otherwise(2)).otherwise(0)).alias("grade"))
    n = marks.count()
    if not n:
        return Model([], np.zeros(0), np.array([30.0]))
    ranked = marks.withColumn("rank", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).where(F.col("rank") < min(1.0, max_rows / n) * float(1 << 30))
    drawn = ranked.orderBy("rank", "doc_id").limit(2 * max_rows).drop("rank")
    # at most 2 * max_rows ids and grades: a bounded broadcast; of a repeated id the least text
    sample = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def make():
        def fn(texts):
            shingles = [shingles_of(t, 3) for t in texts]
            return [[sorted(features_of(t)) for t in texts], [int(x.min() >> np.uint64(1)) if len(x) else -1 for x in shingles]]

        return fn

    # near copies of a text mostly share their least shingle, and count once: a word needs texts of its own
    bags = cut(map_texts(sample, make, [T.StructField("bag", T.ArrayType(T.BinaryType())), long("least")], keep=["grade"]))
    bad = F.when(F.col("grade") > 0, F.col("least"))
    good = F.when(F.col("grade") == 0, F.col("least"))
    totals = bags.agg(F.count_distinct(bad).alias("a"), F.count_distinct(good).alias("b")).first()
    toxic, clean = totals.a, totals.b
    if not toxic or not clean:
        return Model([], np.zeros(0), np.array([-30.0 if toxic else 30.0]))
    # word counts are added up on the executors; only words that pass come to the driver
    counts = bags.select(bad.alias("bad"), good.alias("good"), F.explode("bag").alias("word")).groupBy("word").agg(F.count_distinct("bad").alias("a"), F.count_distinct("good").alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(toxic + clean)
    chi = n * F.pow(a * (clean - b) - b * (toxic - a), 2) / ((a + b) * (n - a - b) * float(toxic) * float(clean))
    strong = counts.where((a >= SUPPORT) & (a / toxic >= SHARE * (a / toxic + b / clean)) & (a + b < n)).withColumn("chi", chi).where(F.col("chi") >= CHI)
    picked = strong.orderBy(F.desc("chi"), "word").limit(FEATURES).collect()
    words = distinct_stems([bytes(r.word) for r in picked])
    at = {w: k for k, w in enumerate(words)}

    def known():
        return lambda given: [[sorted(at[w] for w in map(bytes, bag) if w in at) for bag in given]]

    rows = map_texts(bags, known, [T.StructField("at", T.ArrayType(T.LongType()))], "bag", keep=["grade"]).collect()
    forget(bags)
    return fit(sorted((r.grade, r.at) for r in rows), words)


def score(docs: DataFrame, model: Model, text: str = "text", reject: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with severity (expected grade), grade (the likeliest) and rejected (severity of at least ``reject``, by default the model's own cut). Null and empty texts score as texts without a known word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least = model.reject if reject is None else reject

    def make():
        scorer = shared.value.scorer()

        def fn(texts):
            severity, grade = scorer(texts)
            return [severity, grade, [s >= least for s in severity]]

        return fn

    return map_texts(docs, make, [double("severity"), long("grade"), boolean("rejected")], text, keep=keep)
