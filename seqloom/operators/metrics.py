"""Metrics of scores, clusters, positive-unlabelled sets and reliability."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import round_half_up


def smooth(df: DataFrame, by: str, order: Sequence[str], value: str, window: int = 2, keep_peaks: bool = True, method: str = "triangular", sigma: float | None = None) -> DataFrame:
    """Triangular or Gaussian smoothing in the order of each series. Missing scores (null or NaN) weigh nothing and are filled from their neighbours; what has
    none stays missing, and a peak never falls below its own value."""
    w = Window.partitionBy(by).orderBy(*order)
    raw = F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value).cast("double"))
    df = df.withColumn("_raw", raw)
    sigma = sigma if sigma is not None else max(window / 2, 1e-6)
    top, low = F.lit(0.0), F.lit(0.0)
    for k in range(-window, window + 1):
        x = F.lag("_raw", -k).over(w) if k < 0 else F.lead("_raw", k).over(w) if k else F.col("_raw")
        weight = float(window + 1 - abs(k)) if method == "triangular" else math.exp(-(k * k) / (2.0 * sigma * sigma))
        top, low = top + F.coalesce(x * weight, F.lit(0.0)), low + F.when(x.isNotNull(), weight).otherwise(0.0)
    out = F.when(low > 0, top / low)
    return df.withColumn("smooth", F.greatest(out, F.col("_raw")) if keep_peaks else out).drop("_raw")


def _finite(score: str) -> Column:
    x = F.col(score).cast("double")
    return x.isNotNull() & ~F.isnan(x)


def detection(df: DataFrame, score: str, truth: str, threshold: float = 0.5, by: str | None = None, pos: str | None = None, tolerance: int = 0) -> DataFrame:
    """tp, fp, fn, tn, recall, precision, f1, mcc of all rows together; a ratio without rows is null.

    Missing scores are neither called nor counted as residues; a site whose score is missing is missed. With a ``tolerance`` a call up to so many
    positions (``pos``, within ``by``) from a true site finds it, each site once; a task then holds one group's positions.
    """
    if tolerance:

        def match(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(pos)
            there = pdf[score].astype(float).notna()
            sites, called, found, good = set(pdf.loc[pdf[truth] == 1, pos]), pdf.loc[there & (pdf[score] >= threshold), pos].tolist(), set(), 0
            for c in called:
                hit = next((c + d for d in range(-tolerance, tolerance + 1) if c + d in sites and c + d not in found), None)
                if hit is not None:
                    found.add(hit)
                    good += 1
            fn = len(sites) - len(found)
            return pd.DataFrame({"tp": [len(found)], "fp": [len(called) - good], "fn": [fn], "tn": [int(there.sum()) - len(called) - fn]})

        c = df.select(by, pos, score, truth).groupBy(by).applyInPandas(match, "tp long, fp long, fn long, tn long").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn", "tn")])
    else:
        hit, true = _finite(score) & (F.col(score) >= threshold), F.col(truth) == 1
        c = df.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(_finite(score)).alias("_n"))
        c = c.withColumn("tn", F.col("_n") - F.col("tp") - F.col("fp") - F.col("fn")).drop("_n")
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    c = c.withColumns({"recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    return c.withColumn("mcc", ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))


def average_precision(df: DataFrame, by: str, score: str, truth: str, order: Sequence[str], tolerance: int = 0) -> DataFrame:
    """``by, ap``: mean of the precision at each true row over all true rows, best scores first, ties in the given order. Missing scores have no rank; null without
    true rows or without scores, 0 if no true row has one. With a ``tolerance`` ``order`` is the position, and a row so near to a site that none has found yet finds it."""
    if tolerance:

        def match(pdf: pd.DataFrame) -> pd.DataFrame:
            pos = order[0]
            sites, found, total = set(pdf.loc[pdf[truth] == 1, pos]), set(), 0.0
            ranked = pdf[pdf[score].astype(float).notna()].sort_values([score, pos], ascending=[False, True])[pos].tolist()
            for rank, c in enumerate(ranked, 1):
                hit = next((c + d for d in range(-tolerance, tolerance + 1) if c + d in sites and c + d not in found), None)
                if hit is not None:
                    found.add(hit)
                    total += len(found) / rank
            return pd.DataFrame({by: [pdf[by].iloc[0]], "ap": [total / len(sites) if sites and ranked else None]})

        return df.select(by, *order, score, truth).groupBy(by).applyInPandas(match, f"{by} {dict(df.dtypes)[by]}, ap double")
    w = Window.partitionBy(by, "_f").orderBy(F.desc(score), *order)
    rows = df.withColumn("_f", _finite(score)).withColumn("_n", F.row_number().over(w)).withColumn("_t", F.sum(F.col(truth)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hits = (F.col(truth) == 1) & F.col("_f")
    sites = F.sum(F.col(truth))
    return rows.groupBy(by).agg(F.when((sites > 0) & (F.count_if("_f") > 0), F.coalesce(F.sum(F.when(hits, F.col("_t") / F.col("_n"))), F.lit(0.0)) / sites).alias("ap"))


def bootstrap_ci(df: DataFrame, by: str, value: str, key: str, rounds: int = 200, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean and its percentile interval: each round weighs each row by a Poisson number from its hash, so rounds are sums of one pass."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = pdf["_h"].to_numpy().astype(np.int64).view(np.uint64)
            w = np.empty((len(pdf), rounds))
            steps = np.cumsum([np.exp(-1.0) / np.prod(range(1, k + 1)) for k in range(8)])
            for r in range(rounds):
                x = h + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w[:, r] = np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53)
            for name, rows in pdf.groupby(by).indices.items():
                yield pd.DataFrame({by: [name], "sums": [(w[rows] * pdf[value].to_numpy()[rows, None]).sum(axis=0).tolist()], "weights": [w[rows].sum(axis=0).tolist()]})

    kind = dict(df.dtypes)[by]
    part = df.filter(F.col(value).isNotNull()).select(by, value, F.xxhash64(F.lit(seed), key).alias("_h")).mapInPandas(sums, f"{by} {kind}, sums array<double>, weights array<double>")
    each = part.select(by, F.posexplode(F.arrays_zip("sums", "weights")).alias("round", "_z")).groupBy(by, "round").agg((F.sum("_z.sums") / F.sum("_z.weights")).alias("m"))
    spread = each.groupBy(by).agg(F.percentile("m", (1 - ci) / 2).alias("low"), F.percentile("m", (1 + ci) / 2).alias("high"))
    return df.groupBy(by).agg(F.avg(value).alias("mean")).join(spread, by).select(by, "low", "mean", "high")


def centers(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """``label, n, center``: means rounded to 3 digits."""
    agg = [round_half_up(F.avg(F.col(vector)[d].cast("double")), 3).alias(f"_{d}") for d in range(dims)]
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *agg).select(label, "n", F.array(*[F.col(f"_{d}") for d in range(dims)]).alias("center"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def with_centers(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """Rows with their cluster's centre and squared distance to it."""
    return df.join(centers(df, label, vector, dims), label).withColumn("d2", squared_distance(F.col(vector), F.col("center")))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two vectors; null if one is constant."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    product = lambda x, y: total(F.zip_with(x, y, lambda v, w: v.cast("double") * w.cast("double")))
    n, sa, sb = F.size(a), total(a), total(b)
    spread = (product(a, a) - sa * sa / n) * (product(b, b) - sb * sb / n)
    return F.when(spread > 0, (product(a, b) - sa * sb / n) / F.sqrt(spread))


def bic(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """One row ``bic`` of a spherical Gaussian per cluster with one common variance."""
    per = with_centers(df, label, vector, dims).groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("d2").alias("ss"))
    all_ = per.agg(F.sum("n").alias("N"), F.count(F.lit(1)).cast("double").alias("m"), F.sum("ss").alias("ss"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    n, m = F.col("N"), F.col("m")
    var = F.col("ss") / (n - m) / dims
    like = F.col("nlogn") - n * F.log(n) - n * dims / 2.0 * F.log(2 * 3.141592653589793 * var) - (n - m) * dims / 2.0
    return all_.select((like - 0.5 * m * F.log(n) * (dims + 1)).alias("bic"))


def medoids(df: DataFrame, label: str, key: str, vector: str, dims: int, metric: str = "correlation") -> DataFrame:
    """``label, medoid, closeness``: the row that correlates most with the mean of its cluster (``metric`` euclidean: the closest to it), ties by key."""
    means = df.groupBy(label).agg(*[F.avg(F.col(vector)[d].cast("double")).alias(f"_{d}") for d in range(dims)]).select(label, F.array(*[F.col(f"_{d}") for d in range(dims)]).alias("_mean"))
    near = correlation(F.col(vector), F.col("_mean")) if metric == "correlation" else -F.sqrt(squared_distance(F.col(vector), F.col("_mean")))
    best = F.min(F.struct((-near).alias("d"), F.col(key).alias("k")))
    return df.join(means, label).groupBy(label).agg(best.alias("_b")).select(label, F.col("_b.k").alias("medoid"), (-F.col("_b.d")).alias("closeness"))


def distance_to_medoid(df: DataFrame, label: str, key: str, vector: str, dims: int, metric: str = "correlation") -> DataFrame:
    """``key, label, distance``: of each row to its cluster's medoid, 1 - correlation or Euclidean; the medoid's own is 0."""
    chosen = medoids(df, label, key, vector, dims, metric).select("medoid")
    of = df.join(chosen, F.col(key) == F.col("medoid"), "left_semi").select(label, F.col(key).alias("_medoid"), F.col(vector).alias("_v"))
    far = 1 - correlation(F.col(vector), F.col("_v")) if metric == "correlation" else F.sqrt(squared_distance(F.col(vector), F.col("_v")))
    return df.join(of, label).select(key, label, F.when(F.col(key) == F.col("_medoid"), 0.0).otherwise(far).alias("distance"))


def coverage(df: DataFrame, group: str, name: str, reference: DataFrame) -> DataFrame:
    """Percent of the reference's names that each group has."""
    all_ = reference.select(F.countDistinct(name).alias("_all"))
    return df.groupBy(group).agg(F.countDistinct(name).alias("_n")).crossJoin(F.broadcast(all_)).select(group, (F.col("_n") * 100.0 / F.col("_all")).alias("coverage"))


def name_groups(df: DataFrame, group: str, name: str) -> DataFrame:
    """The most frequent name of each group, ties by name."""
    n = df.groupBy(group, name).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), name)
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(group, F.col(name).alias("name"), "n")


def _distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
        return 1 - x @ y.T
    if metric == "manhattan":
        return np.stack([np.abs(x - v).sum(axis=1) for v in y], axis=1)
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0.0))


def mean_distance_to(df: DataFrame, reference: DataFrame, key: str, vector: str, metric: str = "euclidean", block: int = 4096) -> DataFrame:
    """``key, distance``: mean distance to all reference rows. These go to the tasks in blocks of bounded size, one after another; each pass adds its sums."""
    sc = df.sparkSession.sparkContext
    kind = dict(df.dtypes)[key]

    def sums(sent, metric=metric):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(1)
                x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
                y = sent.value
                total = np.zeros(len(x))
                for lo in range(0, len(y), 512):
                    total += _distances(x, y[lo : lo + 512], metric).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(np.full(len(x), len(y)))], names=[key, "_s", "_n"])

        return run

    out, held = None, []
    rows = reference.select(vector).filter(F.col(vector).isNotNull()).toLocalIterator()
    for row in chain(rows, [None]):
        if row is not None:
            held.append(np.asarray(row[0], dtype=float))
        if held and (row is None or len(held) == block):
            part = df.select(key, vector).mapInArrow(sums(sc.broadcast(np.stack(held))), f"{key} {kind}, _s double, _n long")
            out, held = part if out is None else out.unionByName(part), []
    if out is None:
        return df.select(key, F.lit(None).cast("double").alias("distance"))
    return out.groupBy(key).agg((F.sum("_s") / F.sum("_n")).alias("distance"))


def reliable_negatives(distances: DataFrame, key: str, n: int) -> DataFrame:
    """The n unlabelled rows farthest from the positives."""
    return distances.orderBy(F.desc("distance"), key).limit(n)


def sharpness(p: Column) -> tuple[Column, Column]:
    """Margin and entropy (bits) of a probability."""
    term = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    return F.abs(p - 0.5) * 2, term(p) + term(1 - p)


def calibration_bins(df: DataFrame, p: str, truth: str, bins: int = 5) -> DataFrame:
    """``bin, n, mean_p, rate``: equal widths on [0, 1], the last closed on the right."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(truth).cast("double")).alias("rate"))


def conformal_quantile(df: DataFrame, value: str, alpha: float = 0.1) -> DataFrame:
    """One row ``threshold``: the value at the finite-sample level min(1, ceil((n + 1)(1 - alpha)) / n) of n values, its position rounded up."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    every = df.agg(F.count(F.lit(1)).cast("double").alias("_all")).withColumn("_level", F.least(F.lit(1.0), F.ceil((F.col("_all") + 1) * (1 - alpha)) / F.col("_all")))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(every))
    return upto.filter(F.col("_upto") >= F.ceil((F.col("_all") - 1) * F.col("_level")) + 1).agg(F.min(value).alias("threshold"))


def conformal_sets(p: Column, threshold: Column) -> Column:
    pos, neg = 1 - p <= threshold, p <= threshold
    return F.when(pos & neg, "both").when(pos, "pos").when(neg, "neg").otherwise("none")


def uncertainty(mean: Column, std: Column, z: float = 1.645) -> tuple[Column, Column]:
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return clip(mean - z * std), clip(mean + z * std)


def paired_deltas(scores: DataFrame, fold: str, model: str, score: str) -> DataFrame:
    """``model_a, model_b, delta, wins``: mean difference over the folds of each pair of models."""
    a, b = scores.select(fold, F.col(model).alias("model_a"), F.col(score).alias("_a")), scores.select(fold, F.col(model).alias("model_b"), F.col(score).alias("_b"))
    return a.join(b, fold).filter("model_a < model_b").groupBy("model_a", "model_b").agg(F.avg(F.col("_a") - F.col("_b")).alias("delta"), F.count_if(F.col("_a") > F.col("_b")).alias("wins"))


# Intervals and structures


def expand_intervals(df: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """A row per position of each interval (1-based, inclusive)."""
    return df.filter(F.col(stop) >= F.col(start)).withColumn("pos", F.explode(F.sequence(start, stop)))


def pair_bands(df: DataFrame, i: str, j: str, value: str, edges: tuple[int, int] = (5, 15)) -> DataFrame:
    """Row means of a pairwise matrix by bands of sequence distance."""
    d = F.abs(F.col(i) - F.col(j))
    band = F.when(d <= edges[0], "near").when(d <= edges[1], "middle").otherwise("far")
    return df.groupBy(i, band.alias("band")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def contacts(df: DataFrame, key: str, xyz: Sequence[str], radius: float) -> DataFrame:
    """``key, contacts``: rows within the radius, by a grid of cells of that size: only neighbouring cells meet."""
    cell = [F.floor(F.col(c) / radius).cast("int").alias(f"_c{i}") for i, c in enumerate(xyz)]
    rows = df.select(key, *xyz, *cell)
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    around = rows.withColumn("_s", F.explode(shifts)).select(key, *xyz, *[(F.col(f"_c{i}") + F.col(f"_s.{s}")).alias(f"_c{i}") for i, s in enumerate("abc")])
    other = rows.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in xyz], "_c0", "_c1", "_c2")
    near = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in xyz), F.lit(0.0)) <= radius * radius
    hits = around.join(other, ["_c0", "_c1", "_c2"]).filter(near & (F.col(key) != F.col("_k"))).groupBy(key).agg(F.count(F.lit(1)).alias("contacts"))
    return df.select(key).join(hits, key, "left").withColumn("contacts", F.coalesce("contacts", F.lit(0)))
