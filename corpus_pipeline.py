"""Corpus pipeline: quality, near duplicates, benchmark passages, secrets, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, near_copies, quality, secrets
from tidemark.llm.common import materialize, table

#: Documents below this quality score go.
LEAST_QUALITY = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else docs


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; null and empty texts are scored like any other."""
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), _unused(docs, "score")
    return quality.quality_scores(docs, model, score_col=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more): that of the smallest id, the first of equal ids.

    A null id comes after all others. Rows are told apart by number, so that repeated and null ids lose no text.
    The texts are shuffled once, whatever the number of dropped rows is.
    """
    row = _unused(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    groups = near_copies.near_copies(numbered, row).join(ids, "row")
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row"))["row"].alias("kept"))
    gone = materialize(groups.join(least, "root").filter("row <> kept").select(F.col("row").alias(row)), "gone")
    return numbered.join(gone.hint("shuffle_hash"), row, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of benchmark items out of the texts, and drops documents that are mostly such passages."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark."""
    return _counted(secrets.redact_secrets(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, and how often each is taken."""
    return mixing.take(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]
#: SQL can't express the classifier, the near copies' components and the scans; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
