"""Values per residue: labelled windows, annotations and domains laid over positions, means over positions of vectors, and comparisons of centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parts import bound_once, letters_of, window_of
from ..functions.splits import Split
from .metrics import centers, expand_intervals, with_centers
from .models import correlation


def labelled_windows(df_seq: DataFrame, size: int, labels: str = "labels", sequence: str = "sequence", entry: str = "entry") -> DataFrame:
    """``entry, pos, window, label``: one row per residue whose window of odd ``size`` lies inside the sequence; ``labels`` is a text with
    one label per residue, separated by commas. Positions start at 1."""
    half = size // 2
    middle = F.sequence(F.lit(half + 1), F.length(sequence) - half)
    both = F.struct(letters_of(F.col(sequence)).alias("s"), F.split(labels, ",").alias("l"))
    cut = bound_once(both, lambda x: F.transform(middle, lambda p: F.struct(p.alias("pos"), window_of(x["s"], p - half, size).alias("window"), F.get(x["l"], p - 1).alias("label"))))
    return df_seq.filter(F.length(sequence) >= size).select(entry, F.inline(cut))


def annotate(intervals: DataFrame, entry: str, order: str, value: str) -> DataFrame:
    """``entry, pos, value`` of intervals (start, stop); where they overlap, the last by ``order`` holds."""
    return expand_intervals(intervals).groupBy(entry, "pos").agg(F.max_by(value, order).alias(value))


def domain_values(domains: DataFrame, entry: str, order: str, longest: float = 200.0, most: float = 10.0) -> DataFrame:
    """Per residue of a domain (start, stop): boundary flag, relative position, size and number of domains of the entry, both scaled.

    Where domains overlap the first by ``order`` holds; residues outside all have no row.
    """
    kept = domains.filter(F.col("stop") >= F.col("start")).select(entry, order, "start", "stop")
    counts = kept.groupBy(entry).agg(F.count(F.lit(1)).alias("_n"))
    first = expand_intervals(kept).groupBy(entry, "pos").agg(F.min_by(F.struct("start", "stop"), order).alias("_d"))
    size = F.col("_d.stop") - F.col("_d.start") + 1
    return first.join(counts, entry).select(
        entry, "pos",
        ((F.col("pos") == F.col("_d.start")) | (F.col("pos") == F.col("_d.stop"))).cast("int").alias("boundary"),
        F.when(size > 1, (F.col("pos") - F.col("_d.start")) / (size - 1).cast("double")).otherwise(F.lit(0.0)).alias("relative"),
        (size / F.lit(longest)).alias("size"), (F.col("_n") / F.lit(most)).alias("n_domains"),
    )


def position_means(df: DataFrame, key: str, vector: str, dims: int, splits: Sequence[Split]) -> DataFrame:
    """``key, split, value``: the mean of a vector's numbers, one per position, over the positions of each split."""

    def mean(split: Split) -> Column:
        at = [F.col(vector)[p - 1].cast("double") for p in split.positions(dims)]
        return sum(at[1:], at[0]) / float(len(at)) if at else F.lit(None).cast("double")

    rows = F.array(*[F.struct(F.lit(s.label).alias("split"), mean(s).alias("value")) for s in splits])
    return df.select(key, F.inline(rows))


def center_correlations(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """``a, b, correlation`` of the centres of any two clusters; centres are joined, not rows."""
    c = centers(df, label, vector, dims)
    left, right = c.select(F.col(label).alias("a"), F.col("center").alias("_a")), c.select(F.col(label).alias("b"), F.col("center").alias("_b"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", correlation(F.col("_a"), F.col("_b")).alias("correlation"))


def least_center_correlation(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """``label, least``: the smallest correlation of a cluster's rows with its centre."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return with_centers(df, label, vector, dims).groupBy(label).agg(F.min(correlation(doubles, F.col("center"))).alias("least"))


def front_spread(front: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """One row ``spread``: the mean distance of any two points of a front, each objective divided by its range on the front (0 for
    fewer than two points). Equal points are counted once with their number, so copies are no pairs."""
    points = front.groupBy(*objectives).agg(F.count(F.lit(1)).alias("_n"))
    spans = front.agg(*[F.coalesce(F.nullif((F.max(c) - F.min(c)).cast("double"), F.lit(0.0)), F.lit(1.0)).alias(f"_s{i}") for i, c in enumerate(objectives)], F.count(F.lit(1)).alias("_all"))
    a = points.select(*[F.col(c).alias(f"_a{i}") for i, c in enumerate(objectives)], F.col("_n").alias("_na"))
    b = points.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(objectives)], F.col("_n").alias("_nb"))
    pairs = a.join(b, F.struct(*[f"_a{i}" for i in range(len(objectives))]) < F.struct(*[f"_b{i}" for i in range(len(objectives))])).crossJoin(F.broadcast(spans))
    far = sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) / F.col(f"_s{i}")) * ((F.col(f"_a{i}") - F.col(f"_b{i}")) / F.col(f"_s{i}")) for i in range(len(objectives)))
    total = pairs.agg(F.coalesce(F.sum(F.sqrt(far) * F.col("_na") * F.col("_nb")), F.lit(0.0)).alias("_total"))
    n = F.col("_all").cast("double")
    return total.crossJoin(F.broadcast(spans)).select(F.when(n > 1, F.col("_total") / (n * (n - 1) / 2)).otherwise(F.lit(0.0)).alias("spread"))
