"""Simplification of a feature set: scales are swapped for better graded ones that say much the same, under a gate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.splits import Split
from . import matrix as X
from . import stats as T
from .select import pearson

#: Which features are chosen, by id, to a number that is better the higher it is.
Score = Callable[[Sequence[str]], float]


def candidates(scale: str, scales: Mapping[str, Sequence[float]], grade: Mapping[str, int], least: float = 0.7) -> list[tuple[str, int, float]]:
    """``scale, grade, correlation`` of all scales with a better (lower) grade that correlate with this one, also inversely, the best graded first, then the most alike."""
    if scale not in grade:
        return []
    found = [(s, grade[s], pearson(scales[scale], scales[s])) for s in scales if s != scale and s in grade and grade[s] < grade[scale]]
    return sorted((c for c in found if abs(c[2]) >= least), key=lambda c: (c[1], -abs(c[2])))


def candidate_table(df_feat: DataFrame, scales: Mapping[str, Sequence[float]], grade: Mapping[str, int], least: float = 0.7, max_grade: int | None = None) -> DataFrame:
    """``feature, place, scale_id, candidate, grade, correlation`` of the features whose grade is worse than ``max_grade`` (or any): features times scales at most."""
    rows = []
    for r in df_feat.select("feature").orderBy("feature").toLocalIterator():
        head, own = r["feature"].rsplit("-", 1)
        if max_grade is not None and grade.get(own, 0) <= max_grade:
            continue
        rows += [(r["feature"], k, s, f"{head}-{s}", g, float(c)) for k, (s, g, c) in enumerate(candidates(own, scales, grade, least))]
    return df_feat.sparkSession.createDataFrame(rows, "feature string, place int, scale_id string, candidate string, grade int, correlation double")


def number_of(feature: str, parts: Sequence[str], splits: Sequence[Split], names: Sequence[str]) -> int:
    """A feature's number in ``matrix_values``."""
    part, split, scale = feature.split("-")
    place = {s.label: k for k, s in enumerate(splits)}
    return ([p.upper() for p in parts].index(part) * len(splits) + place[split]) * len(names) + list(names).index(scale)


def swap_all(df_feat: DataFrame, df_parts: DataFrame, parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]], grade: Mapping[str, int], least: float = 0.7, max_std: float = 0.2, max_grade: int | None = None, drop: bool = False) -> DataFrame:
    """``feature, swapped_from, grade`` and the statistics of the simplified set: each feature takes its first candidate that varies little in the test group.

    The statistics of all candidates come from one pass. Features without a candidate stay, or go if ``drop``; two that become the same are one."""
    from ..llm._common import cut

    table = candidate_table(df_feat, scales, grade, least, max_grade)
    wanted = sorted({r["candidate"] for r in table.select("candidate").distinct().collect()} | {r["feature"] for r in df_feat.select("feature").collect()})
    numbers = [number_of(f, parts, splits, list(scales)) for f in wanted]
    stats = cut(T.named_stats(T.stats_of_sums(X.matrix_sums(df_parts, parts, splits, scales, numbers))))
    viable = table.join(stats.select(F.col("feature").alias("candidate"), F.col("std_test").alias("_std")), "candidate").filter(F.col("_std") <= max_std)
    first = viable.withColumn("_n", F.row_number().over(Window.partitionBy("feature").orderBy("place"))).filter("_n = 1").select("feature", "candidate", "grade")
    own = df_feat.select("feature").join(first, "feature", "inner" if drop else "left")
    own = own.select(F.coalesce("candidate", "feature").alias("feature"), F.when(F.col("candidate").isNotNull(), F.col("feature")).alias("swapped_from"), "grade")
    once = own.groupBy("feature").agg(F.min("swapped_from").alias("swapped_from"), F.min("grade").alias("grade"))
    return once.join(stats, "feature")


def greedy(features: Sequence[str], scales: Mapping[str, Sequence[float]], grade: Mapping[str, int], score: Score, least: float = 0.7, tolerance: float = 0.0, allow_drop: bool = True) -> tuple[list[str], list[tuple[str, str | None, float, bool]]]:
    """The simplified set and what was tried: per feature the candidates, the best first, until one keeps the score at the baseline less ``tolerance``. A feature that became one the set has
    already is dropped if ``allow_drop``. The score decides on the driver over a set of features, whose number is a parameter."""
    kept, tried = list(features), []
    baseline = score(kept)
    for feature in features:
        head, own = feature.rsplit("-", 1)
        for s, _, _ in candidates(own, scales, grade, least):
            new = f"{head}-{s}"
            if new in kept and not allow_drop:
                continue
            trial = [f for f in ([new if f == feature else f for f in kept] if new not in kept else [f for f in kept if f != feature])]
            got = score(trial)
            ok = got >= baseline - tolerance
            tried.append((feature, new, got, ok))
            if ok:
                kept, baseline = trial, max(baseline, got)
                break
    return kept, tried


def consolidate(features: Sequence[str], subcategory: Mapping[str, str], scales: Mapping[str, Sequence[float]], grade: Mapping[str, int], score: Score, least: float = 0.7, tolerance: float = 0.0) -> list[str]:
    """Fewer subcategories: those with the fewest features first, all of one move to the scales of another that has more, if every one correlates and the score holds."""
    kept, baseline = list(features), score(features)
    scale_of = lambda f: f.rsplit("-", 1)[1]
    sizes: dict[str, int] = {}
    for f in kept:
        sizes[subcategory[scale_of(f)]] = sizes.get(subcategory[scale_of(f)], 0) + 1
    for small in sorted(sizes, key=lambda s: (sizes[s], s)):
        for big in sorted((s for s in sizes if sizes[s] > sizes[small]), key=lambda s: (-sizes[s], s)):
            moves = {}
            for f in (f for f in kept if subcategory[scale_of(f)] == small):
                fit = [c for c in candidates(scale_of(f), scales, grade, least) if subcategory.get(c[0]) == big]
                moves[f] = f"{f.rsplit('-', 1)[0]}-{fit[0][0]}" if fit else None
            if not moves or None in moves.values():
                continue
            trial = list(dict.fromkeys(moves.get(f, f) for f in kept))
            if score(trial) >= baseline - tolerance:
                kept = trial
                break
    return kept


def centroid_accuracy(values: DataFrame, folds: int = 3) -> float:
    """Balanced accuracy of a diagonal linear rule fitted on the other folds: one aggregate for the means and deviations of all folds, one for the scores."""
    rows = values.filter("value IS NOT NULL").withColumn("_f", F.pmod(F.xxhash64(F.lit(17), "entry"), F.lit(folds)).cast("int"))
    per = rows.groupBy("feature", "label", "_f").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    all_ = per.groupBy("feature", "label").agg(*[F.sum(c).alias(f"_{c}") for c in "nsq"])
    other = per.join(all_, ["feature", "label"]).select("feature", "label", "_f", (F.col("_n") - F.col("n")).alias("n"), (F.col("_s") - F.col("s")).alias("s"), (F.col("_q") - F.col("q")).alias("q")).filter("n > 0")
    two = other.groupBy("feature", "_f").agg(*[F.max(F.when(F.col("label") == g, F.col("s") / F.col("n"))).alias(f"m{g}") for g in (0, 1)], (F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), F.lit(2.0))).alias("v"))
    scored = rows.join(two, ["feature", "_f"]).groupBy("entry", "label").agg(F.sum((F.col("value") - (F.col("m0") + F.col("m1")) / 2) * (F.col("m1") - F.col("m0")) / F.greatest("v", F.lit(1e-9))).alias("z"))
    got = scored.agg(F.avg(F.when(F.col("label") == 1, (F.col("z") > 0).cast("double"))).alias("a"), F.avg(F.when(F.col("label") == 0, (F.col("z") <= 0).cast("double"))).alias("b")).first()
    return ((got["a"] or 0.0) + (got["b"] or 0.0)) / 2
