"""Near-duplicate groups by a chosen-path set similarity join over word shingles.

Documents with equal shingle sets form one class. Independent trees branch the classes by selected minwise tokens: the root
nodes of a tree share ``ROOT`` coordinates of its own. A node of at most ``SMALL`` classes is compared exhaustively by
sketch; in a larger node of the first ``PIVOT_TREES`` trees, each class meets the node's pivot. Of these candidates, each
class confirms its nearest and its least on full sets, which makes most groups whole. A large node whose classes are in one
group by then goes no further. In a mixed one, the classes outside its largest group are compared with all of the node on
full sets, block by block, if they are at most ``OUTSIDE``; else the node branches again by coordinates that its own path
chooses, where only children that outsiders reach are made. So a group of near copies of any size connects without listing
its pairs, and a row meets a bounded number of others at each level. Last, the candidates of small nodes that lie between
different groups are confirmed on full sets.

A pair at the threshold is missed by all trees with a probability of at most ``LOSS`` at every depth (at 80 %, by
independent coordinates: 26 trees, each shares it with 0.41, 0.40, 0.40, 0.39 after 0 to 3 levels), and by its sketches with about 1e-5. Sketches
only select candidates. Groups come from local contraction in blocks of bounded size, then hooking and pointer jumping
over tables in the shared folder. Nothing is collected but filters of fixed size, and hot nodes meet only joins that
adaptive execution can split, or pre-aggregated counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.llm.common import M1, filter_of, flagged, long, map_texts, mix, passes, rolled, unwrap, word_hashes, wrap
from postern.shared import cut, forget, scratch, small_batches

#: Words of a shingle and similarity in percent where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: Coordinates of a root, chance that no tree joins a pair at the threshold, trees with pivots, (children, coordinates of each) by level, classes of a small node.
ROOT, LOSS, PIVOT_TREES, BRANCH, SMALL = 4, 3e-6, 8, ((4, 2), (8, 4), (8, 4)), 24
#: Outsiders of a large node that are compared with all of it, and classes of either side of a block of such comparisons.
OUTSIDE, SIDE = 2048, 256
#: Minwise coordinates; edges that a task contracts at once.
COORDS, BLOCK = 128, 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DRAW = np.random.default_rng(20240229)
_A = _DRAW.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def reach_of(percent: int, depth: int) -> float:
    """Chance that a pair at the threshold shares a node of one tree after ``depth`` levels of branching."""
    p = percent / 100
    return p**ROOT * math.prod(1 - (1 - p**width) ** count for count, width in BRANCH[:depth])


def trees_of(percent: int) -> int:
    """Trees that miss a pair at the threshold with at most LOSS, even if all its nodes branch to the last level."""
    return math.ceil(math.log(LOSS) / math.log1p(-reach_of(percent, len(BRANCH))))


def slack_of(percent: int) -> int:
    """Mismatches of 2-bit sketches that a pair at the threshold stays within, but for about one in 100,000."""
    q = 0.75 * (1 - percent / 100)
    return math.floor(COORDS * q + 4.3 * math.sqrt(COORDS * q * (1 - q)))


def shingles_of(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; with fewer words the whole sequence is one."""
    found = text.translate(_LOWER).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(rolled(word_hashes(found), min(words, len(found))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """A hash of the least value of each coordinate."""
    least = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * _A + _B).min(axis=0), out=least)
    return mix(least + M1)


B = ("b1", "b2", "b3", "b4")


def sketch(sig: np.ndarray) -> list[int]:
    """Two bits of each coordinate, in signed numbers."""
    bits = ((sig >> np.uint64(7)) & np.uint64(3)).reshape(len(B), 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


SIGNED = [long("n_shingles"), long("s1"), long("s2"), *map(long, B), T.StructField("sig", T.BinaryType())]


def signed(docs: DataFrame, words: int, text: str, keep: list[str]) -> DataFrame:
    """Per row the size and digest of its set, its sketch, and 16 bits of each coordinate."""

    def make():
        def fn(texts):
            rows = []
            for t in texts:
                s = shingles_of(t, words)
                if not len(s):
                    rows.append((0, *[None] * (len(SIGNED) - 1)))
                    continue
                sig = signature(s)
                both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                rows.append((len(s), *both, *sketch(sig), (sig >> np.uint64(40)).astype(">u2").tobytes()))
            return [list(c) for c in zip(*rows, strict=True)] or [[]] * len(SIGNED)

        return fn

    return map_texts(docs, make, SIGNED, text, keep=keep)


Side = Callable[[str], Column]


def apart(x: Side, y: Side) -> Column:
    """Mismatches of two sketches."""
    differ = [x(k).bitwiseXOR(y(k)) for k in B]
    return reduce(lambda p, q: p + q, (F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555))) for d in differ))


def alike(x: Side, y: Side, percent: int) -> Column:
    """Sizes and sketches allow the similarity."""
    return (F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent) & (apart(x, y) <= slack_of(percent))


def side(prefix: str = "") -> Side:
    return lambda k: F.col(prefix + k)


SHAPE = ("cid", "n", *B)


def root_nodes(classes: DataFrame, percent: int) -> DataFrame:
    """Rows (key, t, c, pivot, and the class) of all root nodes of two classes or more."""
    draw = np.random.default_rng(7)
    token = lambda at: F.substring("sig", 2 * int(at) + 1, 2)
    keys = F.array(*[F.xxhash64(F.lit(t), *[token(c) for c in draw.choice(COORDS, ROOT, replace=False)]) for t in range(trees_of(percent))])
    rows = classes.select(*SHAPE, F.posexplode(keys).alias("t", "key"))
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("c"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("c > 1"))
    shared = flagged(rows, F.col("key"), filter_of(counts, "key")).where("flag_")
    nodes = cut(shared.join(counts, "key").select("key", "t", "c", F.when(F.col("t") % 2 == 0, F.col("lo")).otherwise(F.col("hi")).alias("pivot"), *SHAPE))
    forget(counts)
    return nodes


def within(nodes: DataFrame, percent: int, *more: str) -> DataFrame:
    """Candidates (a < b, d mismatches) of small nodes, all against all; with ``root`` in ``more``, between groups only."""
    members = nodes.groupBy("key").agg(F.collect_list(F.struct(*SHAPE, *more)).alias("m")).select("m", F.explode("m").alias("x"))
    x: Side = lambda k: F.col(f"x.{k}")
    meets = lambda y: (y["cid"] > x("cid")) & alike(x, y.getField, percent) & (y["root"] != x("root") if "root" in more else F.lit(True))
    pairs = members.select("x", F.explode(F.filter("m", meets)).alias("y"))
    return pairs.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), apart(x, lambda k: F.col(f"y.{k}")).alias("d"))


def with_pivots(nodes: DataFrame, percent: int) -> DataFrame:
    """Candidates of large nodes: each class with its node's pivot."""
    large = nodes.where((F.col("c") > SMALL) & (F.col("t") < PIVOT_TREES))
    heads = large.where("cid = pivot").select("key", *[F.col(k).alias(f"p_{k}") for k in SHAPE])
    met = large.join(heads, "key").where((F.col("cid") != F.col("p_cid")) & alike(side(), side("p_"), percent))
    return met.select(F.least("cid", "p_cid").alias("a"), F.greatest("cid", "p_cid").alias("b"), apart(side(), side("p_")).alias("d"))


def best(pairs: DataFrame, percent: int) -> DataFrame:
    """Each class with its candidate of the fewest mismatches and the least one that is likely similar: (a, b)."""
    sides = pairs.select("a", "b", "d").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    likely = (F.col("d") <= int(0.75 * COORDS * (1 - percent / 100))) & (F.col("b") < F.col("a"))
    chosen = sides.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m"), F.min(F.when(likely, F.col("b"))).alias("first"))
    each = chosen.select("a", F.explode(F.array_compact(F.array_distinct(F.array("m.b", "first")))).alias("b"))
    return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cid, shingles) of the wanted classes, from one more read of the texts. A filter of fixed size keeps most other texts out."""
    packed = filter_of(wanted.select(F.xxhash64("doc_id").alias("h")), "h")

    def make():
        seen: set[bytes] = set()  # copies of a text are given once a task

        def fn(texts, hashes):
            out = []
            for t, ok in zip(texts, passes(packed.value, hashes), strict=True):
                s = shingles_of(t, words) if ok else ()
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""
                if not digest or digest in seen:
                    out.append((None, None, None))
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(digest)
                out.append((*np.frombuffer(digest, np.int64).tolist(), s.tobytes()))
            return [list(c) for c in zip(*out, strict=True)] or [[]] * 3

        return fn

    rows = docs.select("text", F.xxhash64("doc_id").alias("h"))
    given = map_texts(rows, make, [long("s1"), long("s2"), T.StructField("shingles", T.BinaryType())], ["text", "h"], keep=[]).where("shingles is not null")
    # copies whose ids differ are rows of other tasks: few, and equal
    return given.join(wanted.select("cid", "s1", "s2"), ["s1", "s2"]).select("cid", "shingles")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, *more: str) -> DataFrame:
    """The pairs (a, b, and other numbers of theirs) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
    names = ["a", "b", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(names).filter(pa.array(ok, pa.bool_()))

    return both.select(*names, "x", "y").mapInArrow(run, T.StructType([long(n) for n in names]))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of every id of a task's edges: the least id that these edges reach."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = list(parent)
    for at in range(0, len(ids), 1 << 16):
        part = ids[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["id", "root"])


def relabel(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by its root."""
    to = labels.select(F.col("id").alias("id_"), F.col("root").alias("root_"))
    return rows.join(to, F.col(column) == F.col("id_"), "left").withColumn(column, F.coalesce("root_", column)).drop("id_", "root_")


def groups(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, root): the least id of the connected component of each id that has an edge. Columns of ``edges``: a, b.

    Tasks contract ``block`` edges each; what ids of several tasks still connect is contracted again.
    """
    ordered = lambda x: x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cut(ordered(edges.select("a", "b")))
    schema = T.StructType([long("id"), long("root")])
    labels: DataFrame | None = None
    while n := left.count():
        tasks = -(-n // block)
        stars = cut(left.repartition(tasks).mapInArrow(contract, schema))
        parents = stars
        if tasks > 1:
            parents = cut(stars.groupBy("id").agg(F.min("root").alias("root")))
            while True:
                jumped = cut(relabel(parents.withColumn("was", F.col("root")), parents, "root"))
                parents = jumped.select("id", "root")
                if jumped.where("was <> root").isEmpty():
                    break
        labels = parents if labels is None else cut(relabel(labels, parents, "root"))
        if tasks == 1:
            break
        left = cut(ordered(relabel(relabel(stars.select(F.col("id").alias("a"), F.col("root").alias("b")), parents, "a"), parents, "b")))
    return left.sparkSession.createDataFrame([], schema) if labels is None else labels


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that lie between groups, with the groups as ra and rb."""
    return relabel(relabel(pairs.withColumns({"ra": F.col("a"), "rb": F.col("b")}), labels, "ra"), labels, "rb").where("ra <> rb")


def mixed(nodes: DataFrame) -> DataFrame:
    """Nodes (key, root, class) of several groups, with ``main``, the largest, ``all``, their classes, and ``outside``, how many of them are not of it."""
    sizes = nodes.groupBy("key", "root").agg(F.count("*").alias("c"))
    heads = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all"), F.count("*").alias("n_groups")).where("n_groups > 1")
    # written, so that the join deals its rows by itself and adaptive execution can split a hot node
    small = cut(heads.select("key", F.col("m.root").alias("main"), "all", (F.col("all") - F.col("m.c")).alias("outside")))
    return cut(nodes.join(small, "key"))


class Guests:
    """Shingle sets as an inverted index: how many shingles each shares with a given set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.vocab, starts = np.unique(values[order], return_index=True)
        self.starts = np.append(starts, len(values))

    def similar(self, other: np.ndarray, percent: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocab, other), len(self.vocab) - 1)
        at = at[self.vocab[at] == other]
        lo, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        each = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        same = np.bincount(self.owners[each], minlength=len(self.sizes))
        return np.flatnonzero(100 * same >= percent * (self.sizes + len(other) - same))


def compared(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (ra, rb) between groups that classes outside a node's main group have with any of the node, on full sets.

    Members and outsiders are dealt into blocks of about ``SIDE``; each task holds one block of outsiders and streams members.
    """
    count = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    place = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), count(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    members = nodes.select("cid", "key", "root", place("all", 1).alias("block"), every("outside").alias("part"), F.lit(1).alias("role"))
    guests = nodes.where("root <> main").select("cid", "key", "root", every("all").alias("block"), place("outside", 2).alias("part"), F.lit(0).alias("role"))
    rows = members.union(guests).join(sets, "cid").select("key", "block", "part", "role", "root", "shingles")
    dealt = rows.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, roots, guests, links = None, [], [], None, set()

        def drain() -> pa.RecordBatch:
            pairs = sorted(links)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["ra", "rb"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for key, block, part, role, root, shingles in zip(*columns, batch.column(5), strict=True):
                if (key, block, part) != at:
                    at, held, roots, guests = (key, block, part), [], [], None
                shingles = np.frombuffer(shingles.as_buffer(), np.uint64)
                if role == 0:
                    held.append(shingles.copy())
                    roots.append(root)
                    continue
                if not held:
                    continue
                guests = guests or Guests(held)
                links.update((min(root, roots[k]), max(root, roots[k])) for k in guests.similar(shingles, percent).tolist() if roots[k] != root)
            if len(links) > 1 << 16:
                yield drain()
        yield drain()

    return dealt.mapInArrow(run, T.StructType([long("ra"), long("rb")])).distinct()


def children(classes: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Rows (key, root, class) of the children of mixed nodes, along coordinates chosen by the node's key. Only children that hold an outsider are made."""
    count, width = BRANCH[level]
    paths = nodes.groupBy("cid").agg(F.first("root").alias("root"), F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("root") != F.col("main"), F.col("key"))).alias("out"))
    near = flagged(classes.select(*SHAPE, "sig"), F.col("cid"), filter_of(nodes, "cid")).where("flag_").drop("flag_")
    rows = cut(near.join(paths, "cid"))

    def child_keys(packed=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for sig, keys in zip(batch.column("sig").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                    found = []
                    for key in keys:
                        for j in range(count):
                            at = np.random.default_rng([key & (2**63 - 1), level, j]).choice(COORDS, width, replace=False)
                            found.append(xxhash.xxh3_64_intdigest(key.to_bytes(8, "big", signed=True) + bytes([j]) + b"".join(sig[2 * k : 2 * k + 2] for k in at)) - (1 << 63))
                    if packed is not None and found:
                        found = np.asarray(found, np.int64)[passes(packed.value, np.asarray(found, np.int64))].tolist()
                    made.append(found)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*SHAPE, "root")], pa.array(made, pa.list_(pa.int64()))], names=[*SHAPE, "root", "made"])

        return run

    schema = T.StructType([*[long(k) for k in (*SHAPE, "root")], T.StructField("made", T.ArrayType(T.LongType()))])
    shape = [F.col(k).cast("long").alias(k) for k in (*SHAPE, "root")]
    reached = rows.where(F.size("out") > 0).select(*shape, "sig", F.col("out").alias("keys")).mapInArrow(child_keys(), schema)
    packed = filter_of(reached.select(F.explode("made").alias("key")), "key")
    return rows.select(*shape, "sig", "keys").mapInArrow(child_keys(packed), schema).select(*SHAPE, "root", F.explode("made").alias("key"))


def merged(labels: DataFrame, upper: DataFrame) -> DataFrame:
    """Groups of groups: ids keep their label's root, and roots that only ``upper`` knows join in."""
    new = upper.join(labels.select("id"), "id", "left_anti").select("id", "root")
    return cut(relabel(labels, upper, "root").select("id", "root").union(new))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, group: bool = False) -> DataFrame:
    """``keep`` columns (default: all others) with n_shingles, component_id (least doc_id of the group) and kept.

    Null texts and texts without words have an empty set, link with nothing and are their own group. Rows of one set, repeated
    rows too, are one class. A null doc_id takes part but never names a group. ``rid`` numbers the rows of the result.
    With ``group``, group_id is the same for the rows of one group only, whatever their ids; rows without a set have none.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"n_shingles", "component_id", "kept", "rid"}]
    docs = wrap(docs, names, doc_id=doc_id, text=text)
    with scratch(docs.sparkSession) as stays, small_batches(docs.sparkSession):
        rows = cut(signed(docs, words, "text", ["row_", "doc_id"]).withColumn("rid", F.monotonically_increasing_id()))
        least = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct("rid", F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"), *B, "sig")).alias("r"), F.min("doc_id").alias("first_id"))
        classes = cut(least.select(F.col("r.rid").alias("cid"), "s1", "s2", F.col("r.d").alias("doc_id"), *[f"r.{k}" for k in ("n", *B, "sig")], "first_id"))
        roots = nodes = root_nodes(classes, percent)
        pairs = cut(within(nodes.where(F.col("c") <= SMALL), percent).union(with_pivots(nodes, percent)).distinct())
        of_ids = lambda ids: classes.join(ids, "cid", "left_semi").select("cid", "s1", "s2", "doc_id")
        known = cut(of_ids(ends_of(pairs)))
        sets = cut(sets_of(docs, known, words))
        # each class with its nearest and its least candidate: most groups are whole then
        first = cut(best(pairs, percent))
        labels = groups(confirm(first, sets, percent))
        links = []
        nodes = relabel(nodes.where(F.col("c") > SMALL).select("key", *SHAPE, F.col("cid").alias("root")), labels, "root")
        for level in range(len(BRANCH) + 1):
            nodes = mixed(nodes)
            if level == 0:
                forget(roots)
            if nodes.isEmpty():
                break
            new = cut(of_ids(nodes.select("cid").distinct().join(known.select("cid"), "cid", "left_anti")))
            if not new.isEmpty():
                known, sets = known.union(new), sets.union(cut(sets_of(docs, new, words)))
            last = level == len(BRANCH)
            links.append(cut(compared(nodes if last else nodes.where(F.col("outside") <= OUTSIDE), sets, percent)))
            nodes = nodes.where(F.col("outside") > OUTSIDE)
            if last or nodes.isEmpty():
                break
            nodes = children(classes, nodes, level)
        # what small nodes hold between groups
        rest = between(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), labels)
        links.append(confirm(rest, sets, percent, "ra", "rb").select("ra", "rb"))
        labels = merged(labels, groups(reduce(DataFrame.union, links).toDF("a", "b")))
        of_id = classes.select("cid", "first_id").join(labels, F.col("cid") == F.col("id")).select("cid", "first_id", "root")
        named = cut(of_id.join(of_id.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select(F.col("cid").alias("id"), "least_id", F.col("root").alias("group_root")))
        of_class = cut(classes.select("cid", F.col("s1").alias("c1"), F.col("s2").alias("c2"), "first_id").join(named, F.col("cid") == F.col("id"), "left").select("c1", "c2", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("group_root", "cid").alias("group_id")))
        stays += [rows, of_class]
    out = rows.join(of_class, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    own = F.col("doc_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(own)
    return out.select(*unwrap(names), "n_shingles", component.alias("component_id"), own.eqNullSafe(component).alias("kept"), "rid", *["group_id"] * group)


#: DuckDB: full sets, counts of shared shingles, components by recursion.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, r, array_to_string(w[k : k + 1], ' ') AS g
  FROM (SELECT doc_id, r, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, r, count(*) AS n FROM s GROUP BY doc_id, r),
pairs AS (
  SELECT a.r AS ra, b.r AS rb, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), links AS (
  SELECT na.doc_id AS a, nb.doc_id AS b FROM pairs JOIN n na ON ra = na.r JOIN n nb ON rb = nb.r WHERE 100 * c >= 80 * (na.n + nb.n - c)
), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.id, sides.b FROM reach JOIN sides ON reach.other = sides.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN comp ON comp.id = d.doc_id
"""
