"""Information-theoretic sanitisation of personal data.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers, found in the whole text. Each base value
is a protected entity. Words may reveal it: over the whole corpus, n(t, e) rows hold term t and entity e, anywhere in the
row, n(t) rows hold t, n(e) rows hold e. A term discloses e when n(t, e) is at least ``SUPPORT``, P(e | t) at least
``SHARE``, more than P(e), and n(t) times the divergence of P(e | t) from P(e) at least ``BITS`` and the logarithm of the
number of pairs tested: chance gives any such pair with about 2^-BITS. A frequent entity reaches that by terms of more rows.
Every occurrence of a disclosing term, in all rows, is a span of kind ``term``. In the clean text entities are replaced by their
kind and disclosing terms are generalised to ``[TERM]``.

Rows of entities and terms are counted in one read, within tasks first, then by key. Terms are paired with entities of
``SUPPORT`` rows only, and only terms rare enough to reach ``SHARE`` are, by bitmaps of fixed size; the exact joins follow.
The disclosing terms go to the workers as at most ``TOLD`` numbers at a time: one more read of the texts for each such lot.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.llm.common import filter_of, long, map_texts, passes, string, unwrap, wrap
from postern.shared import cut, scratch

KINDS = ("email", "ip", "card", "phone", "term")
TERM_KIND = 4
#: Rows of a pair, P(e | t), bits.
SUPPORT, SHARE, BITS = 4, 0.8, 6.0
#: Disclosing terms that a worker holds at once.
TOLD = 1 << 20
#: Rows of an entity up to which it is of a level.
LEVELS = (16, 256, 4096)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORDS = re.compile(r"[^\W\d_]{4,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the pattern, found from each ``@`` so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append((lo, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind as a number, end, normalised value), by start and kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end(), m[0]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 10 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def term_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower().encode()) - (1 << 63)


def entity_hash(kind: int, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}".encode()) - (1 << 63)


class Terms:
    """Hashes of the words that pass a test. Words met before are not hashed again; a full store is emptied."""

    def __init__(self, test: Callable[[list[int]], Iterable[bool]]):
        self.test, self.met, self.good = test, set(), {}

    def of(self, words: set[str]) -> dict[str, int]:
        if len(self.met) > 300_000:
            self.met.clear()
            self.good.clear()
        if new := list(words - self.met):
            h = [term_hash(w) for w in new]
            self.good.update((w, x) for w, x, ok in zip(new, h, self.test(h), strict=True) if ok)
            self.met.update(new)
        return {w: self.good[w] for w in words & self.good.keys()}


def member(told: np.ndarray) -> Callable[[list[int]], Iterable[bool]]:
    """Whether hashes are among those of a sorted array."""

    def test(hashes: list[int]) -> Iterable[bool]:
        if not len(told) or not hashes:
            return [False] * len(hashes)
        h = np.asarray(hashes, np.int64)
        return told[np.minimum(np.searchsorted(told, h), len(told) - 1)] == h

    return test


def words_of(text: str, spans: list[tuple]) -> list[tuple[int, int]]:
    """Words of at least four letters that meet no base span: (start, end)."""
    out, k = [], 0
    covered: list[list[int]] = []
    for a, b in sorted((x[0], x[2]) for x in spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    for m in _WORDS.finditer(text):
        s, e = m.span()
        while k < len(covered) and covered[k][1] <= s:
            k += 1
        if k == len(covered) or e <= covered[k][0]:
            out.append((s, e))
    return out


def vocabulary(text: str) -> set[str]:
    return {w.lower() for w in set(_WORDS.findall(text))}


def located(text: str, spans: list[tuple]) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words that meet no base span."""
    return [(text[s:f].lower(), s, f) for s, f in words_of(text, spans)]


ENTITY, TERM, ROWS = 0, 1, 2
ARROW_COUNT = [pa.field(n, pa.int64()) for n in ("kind", "key", "k")]


def counted(docs: DataFrame) -> DataFrame:
    """(kind, key, n) in the shared folder: rows that hold each entity and each term, of ``SUPPORT`` rows at least, and all rows."""

    def make():
        def fn(texts):
            held = [Counter(), Counter(), Counter({0: len(texts)})]
            words = Counter()
            for t in texts:
                if t:
                    text = t.decode()
                    held[ENTITY].update({entity_hash(k, v) for _, k, _, v in base_spans(text)})
                    words.update(vocabulary(text))
            for w, k in words.items():
                held[TERM][term_hash(w)] += k
            columns = [np.repeat(np.arange(3), [len(some) for some in held]), *(np.fromiter((x for some in held for x in pick(some)), np.int64) for pick in (Counter.keys, Counter.values))]
            # the slice's counts leave with its first row
            ends = [0, *[len(columns[0])] * len(texts)]
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=ARROW_COUNT))]

        return fn

    kind = T.StructType([long("kind"), long("key"), long("k")])
    rows = map_texts(docs, make, [T.StructField("c", T.ArrayType(kind))], keep=[], slice_rows=8192)
    return cut(rows.select(F.inline("c")).groupBy("kind", "key").agg(F.sum("k").alias("n")).where((F.col("n") >= SUPPORT) | (F.col("kind") == ROWS)))


def disclosing(docs: DataFrame) -> DataFrame:
    """(e, t): terms that disclose an entity, by counts over whole rows of all the corpus.

    P(e | t) of ``SHARE`` needs n(t) <= n(e) / SHARE. So entities of each level meet only terms of at most its bound; both
    filters may pass more, never less.
    """
    counts = counted(docs)
    n = max(counts.where(F.col("kind") == ROWS).agg(F.sum("n")).first()[0] or 0, 1)
    n_e = counts.where(F.col("kind") == ENTITY).select(F.col("key").alias("e"), F.col("n").alias("n_e"))
    n_t = counts.where(F.col("kind") == TERM).select(F.col("key").alias("t"), F.col("n").alias("n_t"))
    if n_e.isEmpty():
        return docs.sparkSession.createDataFrame([], T.StructType([long("e"), long("t")]))
    levels = []
    for low, high in zip((0, *LEVELS), (*LEVELS, None), strict=True):
        of_level = n_e.where(F.col("n_e") > low) if high is None else n_e.where((F.col("n_e") > low) & (F.col("n_e") <= high))
        levels.append((filter_of(of_level, "e"), filter_of(n_t if high is None else n_t.where(F.col("n_t") * SHARE <= high), "t")))

    def make():
        terms = [Terms(partial(passes, t.value)) for _, t in levels]

        def fn(texts):
            out = [[] for _ in texts]
            for k, t in enumerate(texts):
                text = t.decode() if t else ""
                spans = base_spans(text)
                es = sorted({entity_hash(kind, v) for _, kind, _, v in spans})
                level = {e: i for i, (wanted, _) in enumerate(levels) for e, ok in zip(es, passes(wanted.value, es), strict=True) if ok} if es else {}
                if level:
                    words = {w for w, _, _ in located(text, spans)}
                    by_level = {i: sorted(set(terms[i].of(words).values())) for i in set(level.values())}
                    out[k] = [{"e": e, "t": t} for e, i in level.items() for t in by_level[i]]
            return [out]

        return fn

    kind = T.StructType([long("e"), long("t")])
    both = map_texts(docs, make, [T.StructField("p", T.ArrayType(kind))], keep=[], slice_rows=64).select(F.inline("p"))
    pairs = cut(both.groupBy("e", "t").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT).join(n_e, "e").join(n_t, "t"))
    share = F.col("n_te") / F.col("n_t")
    p = F.col("n_e") / F.lit(float(n))
    # 0 log 0 is 0; an entity in every row tells nothing
    rest = F.when((share < 1) & (p < 1), (1 - share) * F.log2((1 - share) / (1 - p))).otherwise(F.lit(0.0))
    bits = F.col("n_t") * (share * F.log2(share / p) + rest)
    return pairs.where((share >= SHARE) & (share > p) & (bits >= BITS + math.log2(max(pairs.count(), 1)))).select("e", "t")


SPAN = T.StructType([long("s"), long("k"), long("f")])
SPANS = T.StructField("span_list", T.ArrayType(SPAN))
REPORT = [*[long(f"n_{k}") for k in KINDS[:4]], string("base_sha256"), string("spans"), SPANS]


def marked(docs: DataFrame, told: np.ndarray, last: bool, digest: bool, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the occurrences of the terms ``told`` added to span_list; with ``last``, the whole report."""
    shared = docs.sparkSession.sparkContext.broadcast(told)
    fields = [*REPORT, string("clean_sha256" if digest else "clean_text")] if last else [SPANS]
    more = "span_list" in docs.columns

    def make():
        terms = Terms(member(shared.value))

        def fn(texts, *before):
            rows = []
            for j, t in enumerate(texts):
                body = t.decode() if t else ""
                base = base_spans(body)
                h = terms.of(vocabulary(body)) if body else {}
                spans = [(s, TERM_KIND, f) for w, s, f in located(body, base) if w in h] if h else []
                if more:
                    spans += [(x["s"], x["k"], x["f"]) for x in before[0][j]]
                if not last:
                    rows.append(([{"s": s, "k": k, "f": f} for s, k, f in spans],))
                    continue
                every = sorted([*[x[:3] for x in base], *spans])
                clean = None if t is None else redact(body, every)
                counts = [sum(k == kind for _, k, _, _ in base) for kind in range(4)]
                clean = clean if clean is None or not digest else hashlib.sha256(clean.encode()).hexdigest()
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), [{"s": s, "k": k, "f": f} for s, k, f in every], clean))
            return [list(c) for c in zip(*rows, strict=True)] or [[]] * len(fields)

        return fn

    return map_texts(docs, make, fields, [text, "span_list"] if more else text, keep=keep)


def sanitise(docs: DataFrame, text: str = "text", keep: list[str] | None = None, digest: bool = False, lot: int = TOLD) -> DataFrame:
    """``keep`` columns (default: all but those replaced) with n_email, n_ip, n_card, n_phone, base_sha256, spans, span_list and clean_text.

    Spans are code-point offsets, end exclusive. A null text counts as empty and has none; its clean text is null. Repeated
    rows count as rows of the corpus and get equal spans. With ``digest``, clean_sha256 takes the place of clean_text.
    """
    made = {*[f.name for f in REPORT], "clean_sha256" if digest else "clean_text"}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    rows = wrap(docs, names, text=text)
    with scratch(docs.sparkSession) as stays:
        told = cut(disclosing(rows.select("text")).select("t").distinct())
        stays.append(told)
    lots = max(1, -(-told.count() // lot))
    for k in range(lots):
        some = told.where(F.pmod(F.xxhash64("t"), F.lit(lots)) == k).toPandas()["t"]  # about ``lot`` numbers
        last = k == lots - 1
        rows = marked(rows, np.sort(some.to_numpy(np.int64)), last, digest, keep=["row_"] if last else ["row_", "text"])
        rows = rows if last else cut(rows)
    return rows.select(*unwrap(names), *[f.name for f in REPORT], "clean_sha256" if digest else "clean_text")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Entities are replaced by their kind, disclosing terms are generalised to [TERM]; overlapping spans become one."""
    out, end = [], 0
    for s, k, f in sorted(spans):
        if s >= end:
            out.append(text[end:s])
            out.append(f"[{KINDS[k].upper()}]")
        end = max(end, f)
    return "".join([*out, text[end:]])
