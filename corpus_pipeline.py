"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the shared folder and reads them
again as the next one's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from seqloom.llm._common import checkpoint_dir, cut, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score 0.5 or more; the model is fitted on the labelled ones among ``docs``.

    Null, empty and unknown texts stay, as do all if there are no labels. Repeated rows go or stay alike, very long texts are judged whole, rows
    without a doc_id are judged too; no rows give none, and columns of any name stay as they are.
    """
    machine = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, machine)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    Null and empty texts and texts of blanks are one group; texts of fewer than five words are one shingle; rows that repeat doc_id and text stay once;
    rows without a doc_id go if another of their group stays; very long texts are compared whole; no rows give none, and columns of any name stay.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of an item of ``benchmark``, verbatim or re-parameterised.

    Null and empty texts stay, as do all if there are no items; null items say nothing; repeated rows go or stay alike; very long texts are judged
    whole; rows without a doc_id are judged too; no rows give none, and columns of any name stay as they are.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the target weights take of 0.8 of all words, each document once at most.

    Null and empty texts have no words and stay if their place is before their leaf's cut; null levels are branches of their own; rows with one doc_id
    stay or go together, those without are one record; no rows give none, and columns of any name stay as they are.
    """
    levels = ("domain", "lang", "source")
    named = docs.select(F.struct("*").alias("packed"), "doc_id", "text", "lang", "source", mixing.domain_of().alias("domain"))
    rows = cut(mixing.with_word_counts(named.select("doc_id", "text", *levels)))
    plan = cut(mixing.plan_mix(rows, "doc_id", levels, mixing.WEIGHTS, mixing.SHARE, epochs=1))
    return mixing.take_mix(named.drop("text"), plan, "doc_id", levels).select("packed.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of each document; a column that is called ``shard`` already is kept as ``shard_input``.

    Rows are kept as they are: null and empty texts, repeated rows, those without a doc_id (one key); no rows give none.
    """
    return sharding.assign_shards(docs, "doc_id", [1.0] * sharding.SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A factorization machine and SimHash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    root = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs.select(*[F.col(c) for c in docs.columns])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
