"""Contributions of features to the scores of a linear model, and generators of windows by rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS
from ..functions.parts import letters_of


def linear_contributions(values: DataFrame, weights: Mapping[str, float], key: str = "entry", background: DataFrame | None = None) -> DataFrame:
    """``key, feature, value``: weight times (value less the background's mean), which are the exact Shapley values of a linear model with independent features.

    Contributions of a row add up to its logit less the mean logit of the background (by default all rows)."""
    table = values.sparkSession.createDataFrame([(f, float(w)) for f, w in weights.items()], "feature string, _w double")
    means = (background if background is not None else values).groupBy("feature").agg(F.avg("value").alias("_m"))
    rows = values.join(F.broadcast(table), "feature").join(means, "feature")
    return rows.select(key, "feature", (F.coalesce(F.col("value") - F.col("_m"), F.lit(0.0)) * F.col("_w")).alias("value"))


def project(df: DataFrame, key: str, vector: str, components: np.ndarray) -> DataFrame:
    """``key, coordinates``: rows, freed of their own mean, laid on components (one per column): the map from vectors into the fitted space."""
    x = F.transform(vector, lambda v: v.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    dots = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in u]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - mean * float(u.sum()) for u in components.T]
    return df.select(key, F.array(*dots).alias("coordinates"))


def position_frequencies(windows: DataFrame, column: str = "window") -> DataFrame:
    """``pos, aa, n``: letters by position."""
    letters = windows.select(F.posexplode(letters_of(F.col(column))).alias("_p", "aa"))
    return letters.groupBy((F.col("_p") + 1).alias("pos"), "aa").agg(F.count(F.lit(1)).alias("n"))


#: Letter groups from which windows may be drawn (fixed values).
PRESETS = {"hydrophobic": "AVILMFWY", "polar": "STNQCG", "charged": "DEKR", "positive": "KRH", "negative": "DE", "aromatic": "FWYH", "small": "AGSCT", "tiny": "AGS", "aliphatic": "AVLI", "disorder": "PESKQGR"}


def synthetic_windows(spark: SparkSession, n: int, size: int, generator: str = "uniform", frequencies: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``id, window`` of n windows: ``uniform`` letters, those of a preset, by ``global`` frequencies (aa, n), or by those of each ``position`` (pos, aa, n). Each letter
    is a hash of seed, window and position, so reruns agree; the tables have 20 rows a position."""
    counts: dict[int, dict[str, int]] = {}
    if generator in ("global", "position"):
        for r in frequencies.collect():
            for p in [r["pos"]] if generator == "position" else range(1, size + 1):
                counts.setdefault(p, {})[r["aa"]] = r["n"]
    letters = PRESETS.get(generator, LETTERS)
    u = lambda p: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(p)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    def letter(p: int):
        of = counts.get(p) or dict.fromkeys(letters, 1)
        names = sorted(of)
        bounds = np.cumsum([of[a] for a in names]) / sum(of.values())
        return F.coalesce(*[F.when(u(p) <= float(b), F.lit(a)) for a, b in zip(names, bounds, strict=True)], F.lit(names[-1]))

    return spark.range(n).select("id", F.concat(*[letter(p) for p in range(1, size + 1)]).alias("window"))


def scrambled(windows: DataFrame, column: str = "window", seed: int = 0) -> DataFrame:
    """Windows with their letters in another order, fixed by a hash of the window, seed and place."""
    keyed = F.transform(letters_of(F.col(column)), lambda a, i: F.struct(F.xxhash64(F.lit(seed), F.col(column), i).alias("h"), a.alias("a")))
    return windows.withColumn("scrambled", F.array_join(F.transform(F.array_sort(keyed), lambda s: s["a"]), ""))


def identity_clusters(df: DataFrame, entry: str, sequence: str, least: float = 0.9, word: int = 9) -> DataFrame:
    """``entry, representative``: greedy by length, for sequences of like length. Longer ones (ties: smaller entry) are representatives of those that share so much of their words
    with them (of the shorter one's distinct words).

    Candidates meet on words, the rarest of each sequence first: a member shares ``least`` of its words, so one of its first (1 - least) part. The greedy order is resolved in rounds: a
    sequence is decided once all longer ones that it is like are."""
    words = df.select(F.col(entry).alias("e"), F.length(sequence).alias("n"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(sequence) - word + 1, F.lit(1))), lambda i: F.substring(sequence, i, F.lit(word)))).alias("w"))
    words = words.withColumn("m", F.size("w"))
    rows = words.select("e", "n", "m", F.explode("w").alias("x"))
    common = rows.groupBy("x").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = rows.join(common, "x")
    spare = rows.select("e", "m").distinct().withColumn("first", F.col("m") - F.ceil(F.lit(least) * F.col("m") - 1e-9) + 1)
    alone = shared.groupBy("e").agg(F.count(F.lit(1)).alias("k"))
    ranked = shared.groupBy("e", "n", "m").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("s"))
    ranked = ranked.join(spare.select("e", "first"), "e").join(alone, "e")
    heads = ranked.withColumn("take", F.greatest(F.col("first") - (F.col("m") - F.col("k")), F.lit(0))).filter("take > 0").select("e", "n", "m", F.explode(F.slice("s", F.lit(1), F.col("take").cast("int"))).alias("_s")).select("e", "n", "m", F.col("_s.x").alias("x"))
    longer = shared.select(F.col("e").alias("r"), F.col("n").alias("rn"), "x")
    met = heads.join(longer, "x").filter((F.col("rn") > F.col("n")) | ((F.col("rn") == F.col("n")) & (F.col("r") < F.col("e")))).select("e", "r").distinct()
    both = met.join(words.select("e", F.col("w").alias("a"), "m"), "e").join(words.select(F.col("e").alias("r"), F.col("w").alias("b")), "r")
    like = [(x["e"], x["r"]) for x in both.filter(F.size(F.array_intersect("a", "b")) >= F.lit(least) * F.col("m") - 1e-9).select("e", "r").toLocalIterator()]
    size = {x["e"]: (-x["n"], x["e"]) for x in words.select("e", "n").join(spare.select("e"), "e").toLocalIterator()} if like else {}
    above: dict = {}
    for e, r in like:
        above.setdefault(e, []).append(r)
    member: dict = {}
    for e in sorted(above, key=size.get):
        leaders = [r for r in above[e] if r not in member]
        if leaders:
            member[e] = min(leaders, key=size.get)
    table = df.sparkSession.createDataFrame(list(member.items()), f"_e {dict(df.dtypes)[entry]}, _r {dict(df.dtypes)[entry]}")
    return df.select(F.col(entry)).join(table, F.col(entry) == F.col("_e"), "left").select(entry, F.coalesce("_r", F.col(entry)).alias("representative"))


def groups_of_correlated(clusters: Sequence[int], finer: Sequence[int]) -> list[str]:
    """Names of two levels of clusters: category and subcategory."""
    return [f"Embeddings_cat{a + 1}_subcat{b + 1}" for a, b in zip(clusters, finer, strict=True)]
