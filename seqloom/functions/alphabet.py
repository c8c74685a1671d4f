"""The 20 canonical letters and a rule for letter scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
GAP = "-"
#: Scale values are whole numbers in units of 1e-5, so that sums are exact in any order.
UNIT = 100_000


def scale_value(letter: int, scale: int) -> int:
    """Value of our generated scales: letter and scale numbers through a fixed polynomial, in hundredths of a percent."""
    return (letter * 37 + scale * 101 + letter * letter * scale * 13) % 1001 * 100


def scale_values(scale: int) -> list[int]:
    return [scale_value(i, scale) for i in range(20)]


def scales_table(spark: SparkSession, n: int) -> DataFrame:
    """Long table ``aa, scale_id, value`` of n generated scales."""
    return spark.createDataFrame([(a, f"SC{s:02d}", scale_value(i, s)) for s in range(n) for i, a in enumerate(LETTERS)], "aa string, scale_id string, value long")


def scale_metadata(spark: SparkSession, n: int) -> DataFrame:
    """``scale_id, category, subcategory, scale_name`` of n generated scales."""
    return spark.createDataFrame([(f"SC{s:02d}", f"cat{s % 3}", f"sub{s % 5}", f"generated scale {s}") for s in range(n)], "scale_id string, category string, subcategory string, scale_name string")


def canonical_sequence(text: Column) -> Column:
    """Letters of a text as a sequence: ASCII letters, upper-cased, canonical ones only."""
    return F.regexp_replace(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), f"[^{LETTERS}]", "")


def replace_non_canonical(sequence: Column, gap: str = GAP) -> Column:
    return F.regexp_replace(sequence, f"[^{LETTERS}]", gap)


def is_canonical(sequence: Column) -> Column:
    return ~sequence.rlike(f"[^{LETTERS}]")


def letter_counts(sequence: Column) -> Column:
    """How often each canonical letter occurs, as an array in the order of LETTERS."""
    return F.array(*[(F.length(sequence) - F.length(F.replace(sequence, F.lit(a), F.lit("")))).cast("long") for a in LETTERS])
