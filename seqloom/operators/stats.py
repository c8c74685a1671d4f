"""Statistics of two labelled groups per feature: one aggregate for moments, one rank window for AUC and Mann-Whitney."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same in every engine."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def group_moments(values: DataFrame, key: str | Sequence[Column | str] = "feature", label: str = "label", value: str = "value", test: int = 1, ref: int = 0) -> DataFrame:
    """Mergeable sums of both groups per feature: n, sum and sum of squares (exact for values with 5 decimals)."""
    units = F.round(F.col(value) * 100000.0).cast("long")
    of = lambda g, x: F.sum(F.when(F.col(label) == g, x))
    sums = []
    for name, g in (("test", test), ("ref", ref)):
        sums += [F.count(F.when(F.col(label) == g, F.col(value))).alias(f"n_{name}"), of(g, units).alias(f"sum_{name}"), of(g, units * units).alias(f"sq_{name}")]
    return values.groupBy(*([key] if isinstance(key, str) else key)).agg(*sums)


def finalize_moments(moments: DataFrame) -> DataFrame:
    """mean_dif, abs_mean_dif, std_test, std_ref (population) from sums."""
    mean = lambda g: F.col(f"sum_{g}") / F.col(f"n_{g}") / 100000.0
    var = lambda g: (F.col(f"sq_{g}").cast("double") / F.col(f"n_{g}") - F.pow(F.col(f"sum_{g}").cast("double") / F.col(f"n_{g}"), F.lit(2.0))) / 1e10
    dif = mean("test") - mean("ref")
    return moments.withColumns({"mean_dif": round_half_up(dif, 6), "abs_mean_dif": round_half_up(F.abs(dif), 6), "std_test": round_half_up(F.sqrt(F.greatest(var("test"), F.lit(0.0))), 6), "std_ref": round_half_up(F.sqrt(F.greatest(var("ref"), F.lit(0.0))), 6)})


def rank_sums(values: DataFrame, key: str = "feature", label: str = "label", value: str = "value", test: int = 1) -> DataFrame:
    """Twice the sum of average ranks of the test group, and both group sizes; every other label is reference.

    Values are counted per (feature, value) first, so a window runs over distinct values and no hot value is a hot row group.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == test).alias("_t"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_twice", (before * 2 + F.col("_n") + 1) * F.col("_t"))
    return ranked.groupBy(key).agg(F.sum("_twice").alias("rank_sum2"), F.sum("_t").alias("n1"), (F.sum("_n") - F.sum("_t")).alias("n0"))


def adjusted_auc(sums: DataFrame) -> DataFrame:
    """auc: (U / n1 n0) - 0.5, and its absolute value, rounded to 3 digits; null if a group is empty."""
    u2 = F.col("rank_sum2") - F.col("n1") * (F.col("n1") + 1)
    auc = u2 / (F.col("n1") * F.col("n0") * 2.0) - 0.5
    return sums.withColumns({"auc": F.when(F.col("n1") * F.col("n0") > 0, round_half_up(auc, 3)), "abs_auc": F.when(F.col("n1") * F.col("n0") > 0, round_half_up(F.abs(auc), 3))})


def mann_whitney(sums: DataFrame, digits: int | None = 6) -> DataFrame:
    """u (the smaller one) and z of the normal approximation, without corrections for ties and continuity."""
    n1, n0 = F.col("n1"), F.col("n0")
    u1 = (F.col("rank_sum2") - n1 * (n1 + 1)) / 2.0
    u = F.least(u1, n1 * n0 - u1)
    z = (u - n1 * n0 / 2.0) / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0)
    return sums.withColumns({"u": u, "z": F.when(n1 * n0 > 0, z if digits is None else round_half_up(z, digits))})


#: Chebyshev coefficients of ln(erfc(x) * exp(x * x) / t) in 4 t - 2, with t = 2 / (2 + x) (fixed values; the relative error is below 1e-12).
ERFC = (
    -1.3026537197817094, 6.4196979235649026e-1, 1.9476473204185836e-2, -9.561514786808631e-3, -9.46595344482036e-4, 3.66839497852761e-4, 4.2523324806907e-5,
    -2.0278578112534e-5, -1.624290004647e-6, 1.303655835580e-6, 1.5626441722e-8, -8.5238095915e-8, 6.529054439e-9, 5.059343495e-9, -9.91364156e-10, -2.27365122e-10,
    9.6467911e-11, 2.394038e-12, -6.886027e-12, 8.94487e-13, 3.13092e-13, -1.12708e-13, 3.81e-16, 7.106e-15, -1.523e-15, -9.4e-17, 1.21e-16, -2.8e-17,
)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, which Spark lacks: a Clenshaw sum in the JVM."""
    t = F.lit(2.0) / (F.lit(2.0) + x)
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("dd"), (F.lit(8.0) / (F.lit(2.0) + x) - 2.0).alias("y"))
    step = lambda s, c: F.struct((s["y"] * s["d"] - s["dd"] + c).alias("d"), s["d"].alias("dd"), s["y"].alias("y"))
    last = F.aggregate(F.array(*[F.lit(c) for c in ERFC[:0:-1]]), zero, step, lambda s: (F.lit(ERFC[0]) + s["y"] * s["d"]) * 0.5 - s["dd"])
    return t * F.exp(last - x * x)


def two_sided_p(z: str | Column) -> Column:
    """2 * P(Z > |z|) of a standard normal Z."""
    z = F.col(z) if isinstance(z, str) else z
    return erfc(F.abs(z) / math.sqrt(2))


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def t_two_sided_p(t: str, degrees: str) -> Column:
    """2 * P(T > |t|) of Student's t; a row per feature."""

    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if v != v or f != f or f <= 0 else beta_fraction(f / 2, 0.5, f / (f + v * v)) for v, f in zip(t.astype(float), n.astype(float), strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(t, degrees)


def t_statistic(moments: DataFrame, digits: int = 4) -> DataFrame:
    """Student's t of two groups with pooled variance, from sums."""
    n1, n0 = F.col("n_test").cast("double"), F.col("n_ref").cast("double")
    ss = lambda g, n: F.col(f"sq_{g}").cast("double") - F.pow(F.col(f"sum_{g}").cast("double"), F.lit(2.0)) / n
    pooled = (ss("test", n1) + ss("ref", n0)) / (n1 + n0 - 2)
    dif = F.col("sum_test") / n1 - F.col("sum_ref") / n0
    return moments.withColumn("t", F.when(pooled > 0, round_half_up(dif / F.sqrt(pooled * (1 / n1 + 1 / n0)), digits)))


def benjamini_hochberg(df: DataFrame, p: str = "p_value", out: str = "p_fdr", within: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """p * n / rank, the least of it from each rank on, at most 1; nulls don't count and stay null. Ties share the greatest rank."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*within, known) if within else Window.partitionBy(known)
    rank = F.count(F.lit(1)).over(w.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    raw = df.withColumn("_raw", F.when(known, F.col(p) * F.count(F.lit(1)).over(w) / rank))
    least = F.min("_raw").over(w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    capped = F.least(least, F.lit(1.0))
    return raw.withColumn(out, F.when(known, capped if digits is None else round_half_up(capped, digits))).drop("_raw")


def value_counts(values: DataFrame, key: str = "feature", label: str = "label", value: str = "value", test: int = 1, ref: int = 0) -> DataFrame:
    """How often each value of a feature occurs in either group: all that its statistics need, from one pass and one partly aggregated shuffle."""
    group = F.col(label)
    return values.filter(F.col(value).isNotNull() & group.isin(test, ref)).groupBy(key, value).agg(F.count_if(group == test).alias("_t"), F.count_if(group == ref).alias("_r"))


def with_zeros(counts: DataFrame, groups: DataFrame, key: str = "feature", label: str = "label", value: str = "value", test: int = 1, ref: int = 0, least: int = 1) -> DataFrame:
    """``value_counts`` of values that are stored where they aren't 0 only: each key gets a row of zeros for the members of ``groups(label)`` that it lacks; keys of fewer than
    ``least`` values go."""
    sizes = groups.agg(F.count_if(F.col(label) == test).alias("_nt"), F.count_if(F.col(label) == ref).alias("_nr"))
    have = counts.groupBy(key).agg(F.sum("_t").alias("_ht"), F.sum("_r").alias("_hr")).filter(F.col("_ht") + F.col("_hr") >= least)
    zeros = have.crossJoin(F.broadcast(sizes)).select(key, F.lit(0.0).alias(value), (F.col("_nt") - F.col("_ht")).alias("_t"), (F.col("_nr") - F.col("_hr")).alias("_r"))
    return counts.join(have.select(key), key, "left_semi").select(key, value, "_t", "_r").unionByName(zeros).groupBy(key, value).agg(F.sum("_t").alias("_t"), F.sum("_r").alias("_r")).filter(F.col("_t") + F.col("_r") > 0)


def stats_of_counts(counts: DataFrame, key: str = "feature", value: str = "value", parametric: bool = False) -> DataFrame:
    """Moments, adjusted AUC, p-value and its correction per feature from ``value_counts``."""
    n = F.col("_t") + F.col("_r")
    before = F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = F.round(F.col(value) * 100000.0).cast("long")
    ranked = counts.withColumn("_twice", (before * 2 + n + 1) * F.col("_t")).withColumn("_u", units)
    moments = [f for c, g in (("_t", "test"), ("_r", "ref")) for f in (F.sum(c).alias(f"n_{g}"), F.sum(F.col("_u") * F.col(c)).alias(f"sum_{g}"), F.sum(F.col("_u") * F.col("_u") * F.col(c)).alias(f"sq_{g}"))]
    return stats_of_sums(ranked.groupBy(key).agg(F.sum("_twice").alias("rank_sum2"), *moments), parametric)


def stats_of_sums(sums: DataFrame, parametric: bool = False) -> DataFrame:
    """The same from ``rank_sum2`` and both groups' sums."""
    sums = sums.withColumns({"n1": F.col("n_test"), "n0": F.col("n_ref")})
    out = mann_whitney(adjusted_auc(finalize_moments(sums)), digits=None)
    if parametric:
        out = t_statistic(out, 9).withColumn("_f", (F.col("n_test") + F.col("n_ref") - 2).cast("double"))
        return benjamini_hochberg(out.withColumn("p_val_ttest_indep", t_two_sided_p("t", "_f")), "p_val_ttest_indep", "p_val_fdr_bh")
    return benjamini_hochberg(out.withColumn("p_val_mann_whitney", two_sided_p("z")), "p_val_mann_whitney", "p_val_fdr_bh")


def feature_stats(values: DataFrame, test: int = 1, ref: int = 0, parametric: bool = False) -> DataFrame:
    """feature, abs_auc, abs_mean_dif, mean_dif, std_test, std_ref, the p-value (``p_val_mann_whitney``, or ``p_val_ttest_indep`` if parametric), p_val_fdr_bh, n_test, n_ref."""
    return named_stats(stats_of_counts(value_counts(values, test=test, ref=ref), parametric=parametric), parametric)


def named_stats(stats: DataFrame, parametric: bool = False) -> DataFrame:
    """The columns of ``feature_stats``."""
    return stats.select("feature", "abs_auc", "abs_mean_dif", "mean_dif", "std_test", "std_ref", "p_val_ttest_indep" if parametric else "p_val_mann_whitney", "p_val_fdr_bh", "n_test", "n_ref")


def mann_whitney_exact_ties(counts: DataFrame, key: str = "feature", value: str = "value") -> DataFrame:
    """``key, u1, p_value``: the normal approximation with its corrections for ties and continuity, as statistics packages give it."""
    n = (F.col("_t") + F.col("_r")).cast("double")
    before = F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = counts.withColumn("_twice", (before * 2 + n + 1) * F.col("_t")).groupBy(key).agg(F.sum("_twice").alias("_s"), F.sum("_t").cast("double").alias("_n1"), F.sum("_r").cast("double").alias("_n0"), F.sum(n * n * n - n).alias("_ties"))
    n1, n0, all_ = F.col("_n1"), F.col("_n0"), F.col("_n1") + F.col("_n0")
    u1 = (F.col("_s") - n1 * (n1 + 1)) / 2
    spread = F.sqrt(n1 * n0 / 12.0 * (all_ + 1 - F.col("_ties") / (all_ * (all_ - 1))))
    z = (F.greatest(u1, n1 * n0 - u1) - n1 * n0 / 2 - 0.5) / spread
    return sums.select(key, u1.alias("u1"), F.when(n1 * n0 > 0, F.when(spread > 0, F.least(F.lit(1.0), two_sided_p(F.greatest(z, F.lit(0.0))))).otherwise(1.0)).alias("p_value"))


def kernel_divergence(values: DataFrame, key: str = "feature", label: str = "label", value: str = "value", points: int = 1000) -> DataFrame:
    """KL(ref || test) of Gaussian kernel densities (Scott's rule) on a common grid, per feature.

    Both densities are sums over the distinct values of a feature with their counts, so a feature's memory follows its distinct values.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count_if(F.col(label) == 1).alias("_t"), F.count_if(F.col(label) != 1).alias("_r"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = pdf[value].to_numpy()
        grid = np.linspace(x.min(), x.max(), points)

        def density(w: np.ndarray) -> np.ndarray:
            n = w.sum()
            mean = (w * x).sum() / max(n, 1)
            std = math.sqrt((w * (x - mean) ** 2).sum() / max(n - 1, 1)) or 1e-9
            h = std * n ** (-0.2)
            out = np.zeros(points)
            for lo in range(0, len(x), 4096):
                out += (w[lo : lo + 4096] * np.exp(-0.5 * ((grid[:, None] - x[lo : lo + 4096]) / h) ** 2)).sum(axis=1)
            return out / out.sum() if out.sum() > 0 else np.full(points, 1 / points)

        if not pdf["_t"].sum() or not pdf["_r"].sum():
            return pd.DataFrame({key: [pdf[key].iloc[0]], "kld": [None]})
        p, q = density(pdf["_r"].to_numpy(float)), density(pdf["_t"].to_numpy(float))
        ok = p > 0
        return pd.DataFrame({key: [pdf[key].iloc[0]], "kld": [float((p[ok] * np.log(p[ok] / np.maximum(q[ok], 1e-300))).sum())]})

    kind = dict(values.dtypes)[key]
    return counts.groupBy(key).applyInPandas(run, f"{key} {kind}, kld double")


