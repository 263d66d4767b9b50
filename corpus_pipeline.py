"""Corpus pipeline over ``documents``: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes and returns whole tables. All but the last return the columns of ``documents``; the last returns the pieces
of packed sequences. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.llm import decontaminate, linededup, neardup, packing, toxicity
from postern.llm.common import table
from postern.shared import cut, forget, scratch


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _with_text(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``text`` becomes the text; n_chars is its length where it changed."""
    changed = ~F.col(text).eqNullSafe(F.col("text"))
    made = {"text": F.col(text), "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return docs.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity rejects them go; the model is fitted on the labelled documents of this input."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not rejected").select(*_columns(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages and chunks of lines go but for the first; a document of which nothing stays goes as well."""
    whole = linededup.dedup_passages(docs).where("passage_lines_removed = 0 or trim(clean_text) <> ''")
    passages = cut(_with_text(whole, "clean_text", docs.columns))
    done = linededup.dedup_lines(passages).where("n_removed = 0 or trim(clean_text) <> ''")
    return _with_text(done, "clean_text", docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the least doc_id, and of its repeated rows in the group the first."""
    marked = neardup.near_duplicates(docs, group=True)
    out = _columns(docs)
    with_set = marked.where("kept and n_shingles > 0")
    # kept rows of one group have one doc_id: number only those groups that keep two
    twice = with_set.groupBy("group_id").agg(F.count("*").alias("c"), F.min("rid").alias("first")).where("c > 1").select(F.col("group_id").alias("again"), "first")
    single = with_set.join(twice, F.col("group_id") == F.col("again"), "left").where("first is null or first = rid")
    return single.select(*out).unionByName(marked.where("n_shingles = 0").select(*out))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are little else go."""
    kept = decontaminate.remove_overlaps(docs.withColumn("before_", F.col("text")), table(spark, sf_dir, "benchmark"))
    return kept.select(*[F.when(F.col("text").eqNullSafe(F.col("before_")), F.col("n_chars")).otherwise(F.length("text").cast("long")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_documents),
    ("benchmark decontamination", decontaminate_benchmark),
    ("packing", pack),
]
#: No SQL expresses a trained model or a tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again. What a stage wrote besides goes with its end, its result with that of the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = cut(stage(spark, docs, sf_dir))
            kept.append(docs)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
