"""Numeric mode: per-item vectors scaled, pooled, combined, averaged by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: x.cast("double"))


def long_vectors(df: DataFrame, key: str, vector: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """``key, dim, value``."""
    return df.select(key, *keep, F.posexplode(as_doubles(vector)).alias("dim", "value"))


def per_dimension(df: DataFrame, vector: str, dims: int, how) -> DataFrame:
    """One row of arrays with ``how(column)`` of each dimension: one pass, no explode."""
    return df.agg(*[how(F.col(vector)[d].cast("double")).alias(f"_{d}") for d in range(dims)]).select(F.array(*[F.col(f"_{d}") for d in range(dims)]).alias("v"))


def encode(df: DataFrame, vector: str, dims: int, method: str = "minmax", clip: tuple[float, float] = (1.0, 99.0)) -> DataFrame:
    """Each dimension to [0, 1]: by its ends, by clipped percentiles, or by the sigmoid of its z-score. Constant ones are 0 (0.5)."""
    x = as_doubles(vector)
    if method == "sigmoid":
        a, b = per_dimension(df, vector, dims, F.avg), per_dimension(df, vector, dims, F.stddev_pop)
    elif method == "quantile":
        a, b = (per_dimension(df, vector, dims, lambda c, q=q: F.percentile(c, q / 100)) for q in clip)
    else:
        a, b = per_dimension(df, vector, dims, F.min), per_dimension(df, vector, dims, F.max)
    fit = a.withColumnRenamed("v", "_a").crossJoin(b.withColumnRenamed("v", "_b"))
    three = F.arrays_zip(x.alias("x"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    if method == "sigmoid":
        scaled = F.transform(three, lambda t: F.when(t["b"] > 0, 1 / (1 + F.exp(-(t["x"] - t["a"]) / t["b"]))).otherwise(0.5))
    else:
        scaled = F.transform(three, lambda t: F.when(t["b"] > t["a"], F.least(F.greatest((t["x"] - t["a"]) / (t["b"] - t["a"]), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))
    return df.crossJoin(F.broadcast(fit)).withColumn(vector, scaled).drop("_a", "_b")


def pool(df: DataFrame, group: str, vector: str, dims: int, how: str = "mean") -> DataFrame:
    """``group, embedding``: the mean or maximum of each dimension."""
    agg = F.avg if how == "mean" else F.max
    return df.groupBy(group).agg(*[agg(F.col(vector)[d].cast("double")).alias(f"_{d}") for d in range(dims)]).select(group, F.array(*[F.col(f"_{d}") for d in range(dims)]).alias(vector))


def pseudo_scales(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, dim, mean, std``: what each group is worth in each dimension."""
    return long_vectors(df, group, vector).groupBy(group, "dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def combine(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors of one key put one after another."""
    return left.join(right.withColumnRenamed(vector, "_more"), key).withColumn(vector, F.concat(vector, "_more")).drop("_more")


def clip01(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest((value - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
