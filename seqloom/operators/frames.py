"""Frames around features: letters, descriptions, column order, importance and impact, and what charts are drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of the columns of a feature table (fixed values); others follow in their own order.
COLUMNS = ("feature", "category", "subcategory", "scale_name", "scale_description", "abs_auc", "abs_mean_dif", "mean_dif", "std_test", "std_ref", "p_val_mann_whitney", "p_val_fdr_bh", "positions")


def sort_columns(df_feat: DataFrame) -> DataFrame:
    """Known columns first, in order; the p-value of a t-test stands where that of the rank test would, before the corrected one. None is dropped."""
    have = df_feat.columns
    ordered = [c for c in COLUMNS if c in have]
    if "p_val_ttest_indep" in have and "p_val_mann_whitney" not in ordered:
        ordered.insert(ordered.index("p_val_fdr_bh") if "p_val_fdr_bh" in ordered else len(ordered), "p_val_ttest_indep")
    return df_feat.select(*ordered, *[c for c in have if c not in ordered])


def feature_letters(sequence: Column, positions: Column, feature: Column) -> Column:
    """The letters at 1-based positions: one after another for segments, with dashes between for patterns."""
    picked = F.transform(positions, lambda p: F.substring(sequence, p, F.lit(1)))
    return F.when(F.contains(feature, F.lit("Segment")), F.array_join(picked, "")).otherwise(F.array_join(picked, "-"))


def feature_descriptions(df: DataFrame) -> DataFrame:
    """A sentence per feature of ``df(feature, subcategory, scale_name, positions)``."""
    part, split = F.split("feature", "-")[0], F.split("feature", "-")[1]
    kind = F.when(F.startswith(split, F.lit("Segment")), "segment").when(F.startswith(split, F.lit("Periodic")), "periodic pattern").otherwise("pattern")
    at = F.concat_ws("-", F.array_min("positions").cast("string"), F.array_max("positions").cast("string"))
    return df.withColumn("description", F.concat(F.lit("Mean of "), "scale_name", F.lit(" ("), "subcategory", F.lit(") over a "), kind, F.lit(" of "), part, F.lit(" at positions "), at))


def add_importance(df_feat: DataFrame, importance: DataFrame) -> DataFrame:
    """Importance in percent of its sum, and its deviation on the same scale; features without one get 0."""
    total = F.sum("importance").over(Window.partitionBy(F.lit(0)))
    scaled = importance.select("feature", (F.col("importance") / total * 100).alias("feat_importance"), (F.col("std") / total * 100).alias("feat_importance_std"))
    return df_feat.join(scaled, "feature", "left").fillna(0.0, ["feat_importance", "feat_importance_std"])


def select_features(df_feat: DataFrame, strategy: str, param: float, by: str = "feat_importance") -> DataFrame:
    """``top_k``: the k highest; ``threshold``: at least so high; ``frequency``: selected in at least such a share of the rounds."""
    if strategy == "top_k":
        return df_feat.orderBy(F.desc(by), "feature").limit(int(param))
    return df_feat.filter(F.col("selection_frequency" if strategy == "frequency" else by) >= param)


def impact(contributions: DataFrame, key: str = "sample", feature: str = "feature", value: str = "value") -> DataFrame:
    """``key, feature, feat_impact``: each contribution in percent of the sample's absolute sum."""
    whole = F.sum(F.abs(value)).over(Window.partitionBy(key))
    return contributions.select(key, feature, F.when(whole > 0, F.col(value) / whole * 100).alias("feat_impact"))


def group_impact(contributions: DataFrame, group: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """``group, feature, feat_impact, feat_impact_std``: mean contribution of a group's samples in percent of the means' absolute sum, the deviation likewise."""
    mean = contributions.groupBy(group, feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    whole = F.sum(F.abs("_m")).over(Window.partitionBy(group))
    return mean.select(group, feature, (F.col("_m") / whole * 100).alias("feat_impact"), (F.col("_s") / whole * 100).alias("feat_impact_std"))


def importance_of_contributions(contributions: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """``feature, feat_importance``: mean absolute contribution, in percent of all."""
    mean = contributions.groupBy(feature).agg(F.avg(F.abs(value)).alias("_m"))
    return mean.select(feature, (F.col("_m") / F.sum("_m").over(Window.partitionBy(F.lit(0))) * 100).alias("feat_importance"))


def sample_mean_dif(values: DataFrame, label_ref: int = 0, key: str = "entry") -> DataFrame:
    """``key, feature, mean_dif``: a sample's value less the mean of the reference samples."""
    ref = values.filter(F.col("label") == label_ref).groupBy("feature").agg(F.avg("value").alias("_ref"))
    return values.join(ref, "feature").select(key, "feature", (F.col("value") - F.col("_ref")).alias("mean_dif"))


# What charts are drawn from


def ranking_frame(df_feat: DataFrame, n: int = 15, by: str = "abs_auc") -> DataFrame:
    """``rank, feature, subcategory, positions, mean_dif, value`` of the n best features."""
    best = df_feat.orderBy(F.desc(by), "feature").limit(n)
    return best.select(F.row_number().over(Window.orderBy(F.desc(by), "feature")).alias("rank"), "feature", "subcategory", "positions", "mean_dif", F.col(by).alias("value"))


def position_frame(df_feat: DataFrame, row: str = "subcategory", value: str = "mean_dif", length: int = 40) -> DataFrame:
    """``row, pos, value`` for every row and position from 1 on (a heat map): the mean at the position, 0 where no feature stands."""
    rows = df_feat.select(row).distinct().withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(length))))
    there = df_feat.select(row, value, F.explode("positions").alias("pos")).groupBy(row, "pos").agg(F.avg(value).alias("value"))
    return rows.join(there, [row, "pos"], "left").fillna(0.0, ["value"])


def profile_frame(df_feat: DataFrame, value: str = "abs_auc", length: int = 40) -> DataFrame:
    """``pos, positive, negative``: the values of all features, shared among their positions, by the sign of their mean difference."""
    rows = df_feat.select((F.col(value) / F.size("positions")).alias("_v"), (F.col("mean_dif") >= 0).alias("_up"), F.explode("positions").alias("pos"))
    sums = rows.groupBy("pos").agg(F.sum(F.when(F.col("_up"), F.col("_v")).otherwise(0.0)).alias("positive"), F.sum(F.when(~F.col("_up"), -F.col("_v")).otherwise(0.0)).alias("negative"))
    every = df_feat.sparkSession.range(1, length + 1).select(F.col("id").cast("int").alias("pos"))
    return every.join(sums, "pos", "left").fillna(0.0, ["positive", "negative"])


def density_frame(values: DataFrame, bins: int = 20) -> DataFrame:
    """``feature, label, bin, share``: histogram of a feature's values by group, on the range of both."""
    ends = values.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = values.filter("value IS NOT NULL").join(ends, "feature").groupBy("feature", "label", at.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("feature", "label", "bin", (F.col("_n") / F.sum("_n").over(Window.partitionBy("feature", "label"))).alias("share"))


def matrix_frame(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """A row per ``row`` and a column per name: the wide form of a map."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def bar_frame(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The n largest bars: ``by, value, share`` of the whole."""
    sums = df.groupBy(by).agg(F.sum(value).alias("value"))
    return sums.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("value"), by).limit(n)
