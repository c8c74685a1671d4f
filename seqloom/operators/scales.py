"""Scale tables and their metadata: reading, filters, chosen sets, composition scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS

#: Marks in scale_ids that don't come from the public index of scales, and of what is unclassified (fixed values).
NOT_INDEXED, UNCLASSIFIED, OTHERS = ("LINS", "KOEH"), "Unclassified", "Others"


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def long_scales(wide: DataFrame, aa: str = "aa") -> DataFrame:
    """``aa, scale_id, value`` of a table with a row per letter and a column per scale."""
    names = [c for c in wide.columns if c != aa]
    return wide.select(quoted(aa).alias("aa"), F.explode(F.array(*[F.struct(F.lit(c).alias("scale_id"), quoted(c).cast("double").alias("value")) for c in names])).alias("_s")).select("aa", "_s.scale_id", "_s.value")


def wide_scales(scales: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per letter and a column per scale."""
    return scales.groupBy("aa").pivot("scale_id", list(names)).agg(F.first("value"))


def read_scales(spark: SparkSession, path: str, sep: str = "\t", aa: str = "AA") -> DataFrame:
    """Long scales of a text table with a header."""
    return long_scales(spark.read.csv(path, sep=sep, header=True, inferSchema=True), aa)


def read_features(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A stored feature set: a text table with a header."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def indexed(scale_id: str = "scale_id") -> Column:
    found = F.lit(False)
    for mark in NOT_INDEXED:
        found = found | F.contains(F.col(scale_id), F.lit(mark))
    return ~found


def classified() -> Column:
    return ~(F.contains(F.col("subcategory"), F.lit(UNCLASSIFIED)) | (F.col("category") == OTHERS))


def filter_scales(metadata: DataFrame, unclassified_out: bool = False, just_indexed: bool = False) -> DataFrame:
    """Metadata without unclassified scales, or without those that are not in the index."""
    if unclassified_out:
        metadata = metadata.filter(classified())
    return metadata.filter(indexed()) if just_indexed else metadata


def pre_select(metadata: DataFrame, categories_out: Sequence[str] = (), subcategories_out: Sequence[str] = ()) -> DataFrame:
    """Metadata without these categories and subcategories."""
    return metadata.filter(~F.col("category").isin(*categories_out) & ~F.col("subcategory").isin(*subcategories_out))


def subcategory_overview(subcategories: DataFrame, metadata: DataFrame, unclassified_out: bool = False, just_indexed: bool = False) -> DataFrame:
    """``subcategories`` with the number of scales of each, all and indexed ones; 0 where there are none."""
    counts = metadata.groupBy("subcategory").agg(F.count(F.lit(1)).alias("n_scales"), F.count_if(indexed()).alias("n_scales_indexed"))
    out = subcategories.join(counts, "subcategory", "left").fillna(0, ["n_scales", "n_scales_indexed"])
    if unclassified_out:
        out = out.filter(classified())
    return out.filter("n_scales_indexed > 0") if just_indexed else out


def members_of_set(matrix: DataFrame, key: str, k: int) -> DataFrame:
    """``scale_id`` of the columns that are not 0 in the matrix's row for set k."""
    names = [c for c in matrix.columns if c != key]
    row = matrix.filter(F.col(key) == k).select(F.explode(F.array(*[F.struct(F.lit(c).alias("scale_id"), quoted(c).alias("v")) for c in names])).alias("_s"))
    return row.filter("_s.v <> 0").select("_s.scale_id")


def scales_of_tier(metadata: DataFrame, tiers: DataFrame, n: int, just_indexed: bool = False) -> DataFrame:
    """``scale_id`` of the scales whose subcategory has tier n at most; those without a tier don't count."""
    return filter_scales(metadata, just_indexed=just_indexed).join(tiers.filter(F.col("tier") <= n).select("subcategory"), "subcategory", "left_semi").select("scale_id")


def listed_ids(ids: Column, sep: str = ";") -> Column:
    """The ids of a joined list; none of an empty or missing one."""
    return F.filter(F.split(F.coalesce(ids, F.lit("")), sep), lambda x: x != "")


def composition_scales(spark: SparkSession) -> DataFrame:
    """A scale for each letter that is 1 for it and 0 for the others: feature values become shares of letters."""
    letters = spark.createDataFrame([(a,) for a in LETTERS], "aa string")
    return letters.crossJoin(F.broadcast(letters.withColumnRenamed("aa", "_of"))).select("aa", F.concat(F.lit("AAC_"), "_of").alias("scale_id"), (F.col("aa") == F.col("_of")).cast("double").alias("value"))


def coverage_of(metadata: DataFrame, chosen: DataFrame, name: str = "subcategory") -> DataFrame:
    """One row ``coverage``: percent of the names that the chosen scales have."""
    have = metadata.join(chosen.select("scale_id"), "scale_id", "left_semi").agg(F.countDistinct(name).alias("_n"))
    return metadata.agg(F.countDistinct(name).alias("_all")).crossJoin(F.broadcast(have)).select((F.col("_n") * 100.0 / F.col("_all")).alias("coverage"))
