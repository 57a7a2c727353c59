"""Corpus preparation in five stages, each one of the operators of keyscape.llm.

A stage takes (spark, docs, sf_dir), with docs in the columns of `documents`, and returns
what it keeps in the same columns; the last one returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyscape.llm import decontam, mixing, pii, quality
from keyscape.llm.runtime import checkpoint, table
from keyscape.llm.setsketch import near_duplicates
from keyscape.sources.shared import remove, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to all labels, doesn't reject."""
    weights = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.score(docs, weights, COLUMNS).filter("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, a similarity of 0.8 or more.

    A document is a pair of doc_id and text, either of which may be null or repeat; of a
    group that of the smallest doc_id stays (null ids last), and of rows that repeat it
    the one smallest in its other columns. Texts without words are like nothing: their
    rows all stay.
    """
    # nulls are marked: a hash skips them. The second hash tells texts apart whose keys are equal by chance; these all stay.
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    docs = docs.select(*COLUMNS).withColumn("_key", key).withColumn("_check", F.xxhash64(F.lit(1), "doc_id", "text"))
    groups = near_duplicates(docs.select(F.col("_key").alias("doc_id"), "text"), width=5, threshold=(80, 100))
    groups = groups.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("component"))
    ids = docs.groupBy("_key").agg(F.min("doc_id").alias("id"), F.min("_check").alias("_check"), F.max("_check").alias("last"))
    ranked = checkpoint(groups.join(ids.filter("_check = last"), "_key").select("_key", "_check", "component", "id"))
    best = ranked.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "_key")).alias("b")).select(F.col("b._key").alias("_key"))
    gone = ranked.join(best, "_key", "left_anti").select("_key", "_check")
    worded = F.coalesce(F.col("text").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    single = docs.filter(worded).groupBy("_key", "_check").agg(F.min(F.struct(*rest, "doc_id", "text")).alias("d"))
    return single.join(gone, ["_key", "_check"], "left_anti").select("d.*").select(*COLUMNS).unionByName(docs.filter(~worded).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark (13 words; a twentieth of the words hit)."""
    found = decontam.removal_spans(docs, table(spark, sf_dir, "benchmark"), window=13, carry=COLUMNS)
    return found.filter("not contaminated").select("doc.*")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; n_chars is that of the new text."""
    clean = pii.redact(docs.select(*COLUMNS))
    changed = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their texts and the words it takes of each (repeats counted)."""
    return mixing.mix(docs, weights=(5, 2, 1), most=3, carry=("text", "lang")).filter("taken > 0")


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", redact_pii),
    ("mix", mix_sources),
]

#: SQL can't express the classifier and the CRF; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; what each hands on is written to the shared folder and read again.

    A written table is removed once the next one is complete; the last one stays, as the result is read from it.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
