"""Feature values: the mean of a letter scale over the letters of a split of a part.

A split's letters are counted once (20 numbers); every scale is then a dot product with those counts. No residue is ever a row, and
nothing is shuffled up to the statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS, UNIT, letter_counts
from ..functions.parts import long_parts
from ..functions.splits import Split, feature_id


def split_letters(df_parts: DataFrame, parts: Sequence[str], splits: Sequence[Split], keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``keep, part, split, letters``: a row per part and split."""
    rows = long_parts(df_parts, tuple(parts), tuple(keep))
    each = F.explode(F.array(*[F.struct(F.lit(s.label).alias("split"), s.letters(F.col("seq")).alias("letters")) for s in splits])).alias("_s")
    return rows.select(*keep, "part", each).select(*keep, "part", "_s.split", "_s.letters")


def rounded_mean(total: Column, n: Column) -> Column:
    """total / n in units of 1e-5, rounded half up, as a double; null without letters."""
    return F.when(n > 0, F.floor(total / n + 0.5) / float(UNIT))


def feature_values(letters: DataFrame, scales: Mapping[str, Sequence[int]], keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``keep, feature, part, split, scale_id, value`` for every scale (values by LETTERS in units of 1e-5); gaps and unknown letters
    don't count."""
    counted = letters.withColumn("_c", letter_counts(F.col("letters"))).withColumn("_n", F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x))
    dot = lambda values: sum((F.col("_c")[i] * v for i, v in enumerate(values)), F.lit(0).cast("long"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scale_id"), rounded_mean(dot(v), F.col("_n")).alias("value")) for s, v in scales.items()])).alias("_v")
    out = counted.select(*keep, "part", "split", each).select(*keep, "part", "split", "_v.scale_id", "_v.value")
    return out.withColumn("feature", feature_id("part", "split", "scale_id"))


def long_scales(scales: DataFrame) -> dict[str, list[int]]:
    """A scale table (aa, scale_id, value), which has 20 rows per scale, as arrays."""
    by: dict[str, list[int]] = {}
    for r in scales.collect():
        if r["aa"] in LETTERS:
            by.setdefault(r["scale_id"], [0] * 20)[LETTERS.index(r["aa"])] = int(r["value"])
    return dict(sorted(by.items()))
