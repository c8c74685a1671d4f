"""Labels of two groups from classes, numbers and partial knowledge."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binary(column: Column, positive) -> Column:
    return (column == F.lit(positive)).cast("int")


def one_vs_rest(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """A row per row and class, with label 1 for the class and 0 for the rest."""
    return df.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes]))).withColumn("y", (F.col(label) == F.col("class")).cast("int"))


def one_vs_one(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """A row per row and pair of classes that it belongs to."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(sorted(classes), 2)])
    out = df.withColumn("_p", F.explode(pairs)).filter((F.col(label) == F.col("_p.a")) | (F.col(label) == F.col("_p.b")))
    return out.withColumn("pair", F.concat_ws("|", F.col("_p.a").cast("string"), F.col("_p.b").cast("string"))).withColumn("y", (F.col(label) == F.col("_p.a")).cast("int")).drop("_p")


def by_quantile(df: DataFrame, target: str, q: float = 0.5) -> DataFrame:
    """1 where the target reaches its linear quantile."""
    cut = df.agg(F.percentile(target, q).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("y", (F.col(target) >= F.col("_cut")).cast("int")).drop("_cut")


def by_tiers(df: DataFrame, target: str, q_pos: float = 0.8, q_neg: Sequence[float] = (0.8, 0.5, 0.3)) -> DataFrame:
    """A row per tier: positives reach the upper quantile in every tier, negatives stay under the tier's, what lies between goes."""
    cuts = df.agg(F.percentile(target, q_pos).alias("_pos"), *[F.percentile(target, q).alias(f"_n{i}") for i, q in enumerate(q_neg)])
    tiers = F.array(*[F.struct(F.lit(float(q)).alias("tier"), F.col(f"_n{i}").alias("cut")) for i, q in enumerate(q_neg)])
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("_t", F.explode(tiers)).withColumn("tier", F.col("_t.tier"))
    y = F.when(F.col(target) >= F.col("_pos"), 1).when(F.col(target) <= F.col("_t.cut"), 0)
    return rows.withColumn("y", y).filter("y IS NOT NULL").drop("_t", "_pos", *[f"_n{i}" for i in range(len(q_neg))])


def positive_unlabelled(label: Column, positive, unlabelled=None, negative=None) -> Column:
    """1 positive, 2 unlabelled, 0 negative; without a value for unlabelled, all the rest is."""
    out = F.when(label == F.lit(positive), 1)
    if negative is not None:
        out = out.when(label == F.lit(negative), 0)
    return out.otherwise(2) if unlabelled is None else out.when(label == F.lit(unlabelled), 2)


def score_band(score: Column, thresholds: Sequence[float]) -> Column:
    """How many thresholds a score reaches; not-a-number is in the top band."""
    return sum((F.when(F.isnan(score) | (score >= float(t)), 1).otherwise(0) for t in sorted(thresholds)), F.lit(0))


def score_group(score: Column, thresholds: Sequence[float], names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (score_band(score, thresholds) + 1).cast("int"))


def region(pos: Column, start: Column, stop: Column) -> Column:
    return F.when(pos < start, "jmd_n").when(pos > stop, "jmd_c").otherwise("tmd")


def balanced_head(df: DataFrame, label: str, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows of each label."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")
