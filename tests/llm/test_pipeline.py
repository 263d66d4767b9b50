"""The corpus pipeline, stage by stage, against plain Python."""

import corpus_pipeline
from postern.llm import decontaminate
from postern.llm.common import table
from postern.shared import cut

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    DATA = "/root/testdata/sf0.01"  # noqa: N806  fewer labels teach no severity
    docs = table(spark, DATA, "documents")
    toxic = {r.doc_id for r in table(spark, DATA, "labels").collect() if r.toxic}
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(cut(stage(spark, steps[-1], DATA)))
    for before, after in zip(steps[:-2], steps[1:-1], strict=True):
        assert after.columns == before.columns and after.count() <= before.count()
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    labelled = {r.doc_id for r in table(spark, DATA, "labels").collect()}
    assert len(toxic & ids[1]) <= 0.5 * len(toxic)  # 50 toxic labels teach the common words only; large tables teach all
    assert len((ids[0] - ids[1]) & (labelled - toxic)) <= 0.02 * len(labelled)
    items = table(spark, DATA, "benchmark")
    left = decontaminate.digest(decontaminate.mark_overlaps(steps[4].select("doc_id", "text"), items, keep=["doc_id"]))
    n_hit = {r.doc_id: r.n_hit for r in left.collect()}
    assert max(n_hit.values()) < 20  # what is cut may join its neighbours, but no passage stays
    assert all(r.n_chars == len(r.text or "") for r in steps[4].collect())
    assert {r.doc_id for r in steps[5].select("doc_id").collect()} == ids[4]


def test_no_rows_and_nulls(spark):
    empty = table(spark, DATA, "documents").limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x y z " * 20, "en", "s", 120), (3, "x y z " * 20, "en", "s", 120)], empty.schema)
    for docs in (empty, odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, DATA))
            docs.count()


def test_one_of_each_group_stays(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(40)) + (" end" if k % 2 else ""), "en", "s", 9) for k in (8, 3, 5)] + [(3, " ".join(f"w{j}" for j in range(40)) + " end", "en", "s", 9)]
    docs = spark.createDataFrame(rows, table(spark, DATA, "documents").schema)
    out = corpus_pipeline.dedup_documents(spark, docs, DATA).collect()
    assert [r.doc_id for r in out] == [3]


def test_unlike_texts_with_null_or_equal_ids_all_stay(spark):
    text = lambda k: " ".join(f"v{k}x{j}" for j in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (8, text(4))]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], table(spark, DATA, "documents").schema)
    out = corpus_pipeline.dedup_documents(spark, docs, DATA).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(None, text(0)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4))], key=repr)


def test_run_leaves_one_table_behind(spark):
    from pathlib import Path

    from postern import shared

    home = Path(shared.folder(spark).removeprefix("file://")) / "postern"
    there = set(home.iterdir()) if home.exists() else set()
    out = corpus_pipeline.run(spark, DATA)
    assert len(set(home.iterdir()) - there) == 1
    assert out.count() > 0
