"""Near-duplicates, line dedup and benchmark decontamination against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postern.llm import decontaminate, linededup, neardup

WORDS = [f"w{k}" for k in range(400)]
DOCS = "doc_id long, text string"


def shingles(text, n):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n):
    """{doc_id: least doc_id that links reach} by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(seed, groups=12, copies=14, edits=9):
    draw = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [draw.choice(WORDS) for _ in range(90)]
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.randrange(edits)):
                words[draw.randrange(len(words))] = draw.choice(WORDS)
            rows.append(" ".join(words))
    draw.shuffle(rows)
    return [(3 * k + 7, t) for k, t in enumerate(rows)]


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


ODD = [(None, "one two three"), (1, None), (2, ""), (3, " \t\n"), (4, "Single"), (5, "single"), (6, "a b"), (6, "a b"), (1000001, "x " * 30_000 + "y")]


@pytest.mark.parametrize("words", [2, 5])
def test_groups_equal_all_pairs(spark, words):
    rows = near_copies(words) + ODD
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), words=words)
    assert found(got) == sorted(components(rows, words), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_large_nodes_branch_and_blocks_split(spark, monkeypatch):
    """With tiny bounds all nodes are large, so pivots, blocks, branches and several contraction tasks all run."""
    rows = near_copies(11, groups=3, copies=40, edits=16)
    for name, value in (("SMALL", 3), ("OUTSIDE", 2), ("SIDE", 4)):
        monkeypatch.setattr(neardup, name, value)
    seen = []
    kept = neardup.children
    monkeypatch.setattr(neardup, "children", lambda *a: seen.append(a[2]) or kept(*a))
    assert found(neardup.near_duplicates(spark.createDataFrame(rows, DOCS), words=2)) == sorted(components(rows, 2), key=repr)
    assert seen


def test_contraction_in_many_blocks(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    want = {x: r for x, r in up.items() if any(x in e for e in edges if e[0] != e[1])}
    for block in (1 << 20, 16):
        got = neardup.groups(spark.createDataFrame(edges, "a long, b long"), block=block)
        assert {r.id: r.root for r in got.collect()} == want


def test_trees_meet_the_loss_at_every_depth():
    for percent in (50, 80, 90):
        n = neardup.trees_of(percent)
        for depth in range(len(neardup.BRANCH) + 1):
            reach = (percent / 100) ** neardup.ROOT
            for count, width in neardup.BRANCH[:depth]:
                reach *= 1 - (1 - (percent / 100) ** width) ** count
            assert (1 - reach) ** n <= 3e-6, (percent, depth)


def test_sketches_allow_the_threshold():
    draw = np.random.default_rng(5)
    missed = 0
    for _ in range(400):
        s = draw.integers(0, 1 << 63, 180, dtype=np.uint64)
        a, b = np.unique(s[:162]), np.unique(s[18:])  # 144 of 180
        x, y = (np.array(neardup.sketch(neardup.signature(t)), np.int64) for t in (a, b))
        d = (x ^ y).view(np.uint64)
        missed += int(np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum()) > neardup.slack_of(80)
    assert missed == 0


def test_near_duplicates_of_nothing_and_with_other_columns(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = spark.createDataFrame([(1, "a b c d e f", 5, "x", None), (2, "a b c d e f", 6, "y", 1)], "doc_id long, text string, s1 int, Kept string, cid int")
    out = neardup.near_duplicates(rows)
    assert [(r.doc_id, r.s1, r.cid, r.kept) for r in out.orderBy("doc_id").collect()] == [(1, 5, None, True), (2, 6, 1, False)]


def by_hand(rows):
    """Line dedup in one loop: {(doc_id, text): clean text}."""
    first, at = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = t.encode()
        lines = b.split(b"\n")
        for lo, hi, ok in linededup.chunks_of(b):
            if ok:
                at.setdefault(b"\n".join(lines[lo:hi]), []).append((i is not None, i or 0, lo, t))
    first = {c: min(v, key=lambda x: x[:3]) for c, v in at.items()}
    out = {}
    for i, t in rows:
        if t is None:
            out[i, t] = None
            continue
        b = t.encode()
        lines = b.split(b"\n")
        stay = [k for lo, hi, ok in linededup.chunks_of(b) for k in range(lo, hi) if not ok or first[b"\n".join(lines[lo:hi])] == (i is not None, i or 0, lo, t)]
        out[i, t] = b"\n".join(lines[k] for k in stay).decode()
    return out


def test_repeated_chunks_go_but_for_the_first(spark):
    draw = random.Random(1)
    shared = "\n".join(f"shared line {k}" for k in range(12))
    long_line = " ".join(draw.choice(WORDS) for _ in range(60))
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(draw.randrange(6))] + [shared] * (k % 2) + [long_line] * (k % 3 == 0) + [f"tail {k}"])) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (None, shared), (103, "\n".join(["row"] * 4000)), (5, rows[5][1])]
    got = {(r.doc_id, r.text): r.clean_text for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    want = by_hand(rows)
    assert got == want
    assert sum(long_line in (t or "") for t in got.values()) == 1
    # a chunk that two texts share survives edits before it
    moved = linededup.dedup_lines(spark.createDataFrame([(1, shared), (2, "something else\nbefore\n" + shared)], DOCS)).orderBy("doc_id").collect()
    assert moved[0].clean_text == shared and moved[1].lines_removed >= 6


def test_line_dedup_of_nothing_and_with_other_columns(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []
    rows = spark.createDataFrame([(1, "a\nb", 1, 2, 3)], "doc_id long, text string, gone int, text_hash int, N_LINES int")
    r = linededup.dedup_lines(rows).first()
    assert (r.gone, r.text_hash, r.n_lines, r.clean_text) == (1, 2, 2, "a\nb")


def passages_by_hand(rows):
    """dedup_passages() in one loop over all runs of lines with 50 words or more, of which those are windows that lose them without their first or last line."""
    places, keys = {}, sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in keys:
        lines = t.split("\n")
        words = [len(x.split()) for x in lines]
        for lo in range(len(lines)):
            for hi in range(lo + 1, len(lines) + 1):
                if sum(words[lo:hi]) >= 50 and (sum(words[lo : hi - 1]) < 50 or sum(words[lo + 1 : hi]) < 50):
                    places.setdefault("\n".join(lines[lo:hi]), []).append(((i is not None, i or 0), lo, hi, t))
    gone, stay = set(), set()
    for found in places.values():
        if len(found) > 1:
            first = min(found, key=lambda x: x[:2])
            for x in found:
                (stay if x is first else gone).update((x[0], x[3], k) for k in range(x[1], x[2]))
    return {(i, t): "\n".join(line for k, line in enumerate(t.split("\n")) if ((i is not None, i or 0), t, k) not in gone - stay) for i, t in keys}


def test_passages_of_50_to_100_words_go_whatever_surrounds_them(spark):
    draw = random.Random(12)
    line = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    passages = [[line(n) for n in sizes] for sizes in ((26, 26), (30, 15, 30), (20, 20, 20), (45, 3, 2), (24, 0, 26), (10, 49, 9, 12))]
    rows = []
    for k in range(60):
        p = passages[k % len(passages)]
        rows.append((k, "\n".join([*(line(draw.randrange(1, 30)) for _ in range(draw.randrange(4))), *p, *(line(draw.randrange(1, 30)) for _ in range(draw.randrange(4)))])))
    rows += [(70, None), (71, ""), (None, "\n".join(passages[0])), (3, rows[3][1])]
    rows += [(80, "\n".join(passages[1] + passages[2])), (81, "own\n" + "\n".join(passages[1] + passages[2])), (82, "\n".join(["row"] * 120))]
    got = {(r.doc_id, r.text): r.clean_text for r in linededup.dedup_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert {k: v for k, v in got.items() if k[1] is not None} == passages_by_hand(rows)
    assert got[70, None] is None and len(got) == len({(i, t) for i, t in rows})
    kept = [sum("\n".join(p) in (t or "") for (i, _), t in got.items() if i is None or i < 80) for p in passages]
    assert kept == [1] * len(passages)


def overlaps(text, items, window=10):
    words = decontaminate.words_of((text or "").encode())
    hit, names = set(), set()
    for item, t in items:
        w = decontaminate.words_of((t or "").encode())
        n = min(window, len(w))
        for g in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w and item is not None else ():
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) == g:
                    hit |= set(range(k, k + n))
                    names.add(item)
    return len(words), sorted(hit), sorted(names)


@pytest.mark.parametrize("shard", [400_000, 30])
def test_windows_equal_brute_force(spark, shard):
    draw = random.Random(shard)
    few = WORDS[:6]
    items = [(f"i{k}", " ".join(draw.choice(few) for _ in range(draw.randrange(1, 16)))) for k in range(25)] + [("short", "Ünï x-Y"), ("i1", "w1 w2 w3"), ("none", None), ("blank", "?!"), (None, "w1 w2")]
    rows = [(k, " ".join(draw.choice(few) for _ in range(draw.randrange(60)))) for k in range(60)] + [(90, None), (91, ""), (92, "ÜNÏ Ünï X.y"), (93, "a " * 20_000)]
    marked = decontaminate.mark_overlaps(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id string, text string"), shard_words=shard)
    for r in marked.collect():
        n, hit, names = overlaps(r.text, items)
        assert (r.n_words, r.hit_items) == (n, names)
        assert [x for lo, hi in zip(r.hit_ranges[::2], r.hit_ranges[1::2], strict=True) for x in range(lo, hi)] == hit
    if shard > 30:
        d = {r.doc_id: r for r in decontaminate.digest(marked).collect()}
        assert all(d[i].n_hit == len(overlaps(t, items)[1]) and d[i].items_sha256 == decontaminate.sha256_of(overlaps(t, items)[2]) for i, t in rows)


def test_removal_cuts_spans_and_drops_covered_documents(spark):
    item = " ".join(f"q{k}" for k in range(12))
    rows = [(1, f"before it, {item}! after all of it", 7), (2, item, 7), (3, None, 7), (4, "clean", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = {r.doc_id: (r.text, r.n_words) for r in decontaminate.remove_overlaps(docs, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert out == {1: ("before it, ! after all of it", 7), 3: (None, 7), 4: ("clean", 7)} or 1 not in out  # 12 of 18 words is under the limit
    assert 1 in out
    none = decontaminate.mark_overlaps(docs, spark.createDataFrame([], "item_id string, text string"))
    assert none.where(F.size("hit_items") > 0).count() == 0
