"""From feature statistics to a selection: positions, names, pre-filter, redundancy, correlation, stability."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.splits import Split
from . import matrix as X
from . import stats as T


def part_span(part: str, start: int = 1, tmd_len: int = 20, jmd_n_len: int = 10, jmd_c_len: int = 10) -> list[int]:
    """Positions of a part in the numbering jmd_n, tmd, jmd_c."""
    n = list(range(start, start + jmd_n_len))
    tmd = list(range(start + jmd_n_len, start + jmd_n_len + tmd_len))
    c = list(range(start + jmd_n_len + tmd_len, start + jmd_n_len + tmd_len + jmd_c_len))
    half = round(tmd_len / 2)
    return {"tmd": tmd, "tmd_e": tmd, "tmd_n": tmd[:half], "tmd_c": tmd[half:], "jmd_n": n, "jmd_c": c, "ext_n": [], "ext_c": [], "tmd_jmd": n + tmd + c, "jmd_n_tmd_n": n + tmd[:half], "tmd_c_jmd_c": tmd[half:] + c, "ext_n_tmd_n": tmd[:half], "tmd_c_ext_c": tmd[half:]}[part]


def part_positions(part: str, split: Split, **lengths: int) -> list[int]:
    span = part_span(part, **lengths)
    return [span[p - 1] for p in split.positions(len(span))]


def feature_positions(spark: SparkSession, parts: Sequence[str], splits: Sequence[Split], scales: Sequence[str], **lengths: int) -> DataFrame:
    """``feature, scale_id, positions`` of parts x splits x scales; as many rows as there are features."""
    at = [(p.upper(), s.label, part_positions(p, s, **lengths)) for p in parts for s in splits]
    rows = spark.createDataFrame(at, "part string, split string, positions array<int>").crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in scales], "scale_id string")))
    return rows.select(F.concat_ws("-", "part", "split", "scale_id").alias("feature"), "scale_id", "positions")


def feature_names(df: DataFrame) -> DataFrame:
    """subcategory [first-last] for segments, [a..b..c] for patterns."""
    many = F.array_join(F.col("positions").cast("array<string>"), "..")
    span = F.concat_ws("-", F.array_min("positions").cast("string"), F.array_max("positions").cast("string"))
    return df.withColumn("name", F.concat(F.col("subcategory"), F.lit(" ["), F.when(F.contains(F.col("feature"), F.lit("-Segment(")), span).otherwise(many), F.lit("]")))


def with_scale_info(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of the scales' metadata (a dimension: one row per scale) by the third field of the feature."""
    if "scale_id" not in df.columns:
        df = df.withColumn("scale_id", F.split("feature", "-")[2])
    return df.join(F.broadcast(metadata), "scale_id", "left")


def n_pre_filter(n_features: int, pct: float = 5, n_filter: int = 100) -> int:
    return max(int(n_features * pct / 100), n_filter)


def prefilter(moments: DataFrame, max_std: float = 0.2, n: int = 10_000) -> DataFrame:
    """The n features with the largest mean difference among those that vary little in the test group."""
    return moments.filter(F.col("std_test") <= max_std).orderBy(F.desc("abs_mean_dif"), "std_test", "feature").limit(n)


def by_position(df_feat: DataFrame, value: str, how: str = "sum", category: str = "category") -> DataFrame:
    """``category, pos, value``: the mean of the features at a position, or the sum of their values shared among their positions."""
    share = F.col(value) if how == "mean" else F.col(value) / F.size("positions")
    rows = df_feat.select(category, share.alias("_v"), F.explode("positions").alias("pos"))
    return rows.groupBy(category, "pos").agg((F.avg("_v") if how == "mean" else F.sum("_v")).alias("value"))


def by_part(df_pos: DataFrame, how: str = "sum", jmd_n_len: int = 10, tmd_len: int = 20) -> DataFrame:
    part = F.when(F.col("pos") <= jmd_n_len, "jmd_n").when(F.col("pos") <= jmd_n_len + tmd_len, "tmd").otherwise("jmd_c")
    agg = {"sum": F.sum, "mean": F.avg, "std": F.stddev_pop}[how]
    return df_pos.groupBy("category", part.alias("part")).agg(agg("value").alias("value"))


def pearson(a: Sequence[float], b: Sequence[float]) -> float:
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    top = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True))
    low = math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    return top / low if low else 0.0


def redundant(positions: set, other: set, max_overlap: float = 0.5) -> bool:
    """Whether a candidate's positions overlap a kept feature's by ``max_overlap`` (Jaccard) at least, or lie inside them."""
    both = len(positions & other)
    return bool(positions | other) and (both / len(positions | other) >= max_overlap or positions <= other)


def greedy_redundancy(df_feat: DataFrame, scales: Mapping[str, Sequence[int]], n: int = 100, max_overlap: float = 0.5, max_cor: float = 0.5, check_category: bool = True, by_characters: bool = False) -> DataFrame:
    """Best features first; one goes if a kept one of its category overlaps in positions and its scale correlates.

    The walk depends on what it has kept, so it runs on the driver, over the pre-filtered features (bounded by their number) as they
    stream in in order, and stops at n. ``by_characters`` compares the characters of the position texts instead of the positions.
    """
    spark = df_feat.sparkSession
    known: dict[tuple[str, str], float] = {}

    def cor(a: str, b: str) -> float:
        if (a, b) not in known:
            known[a, b] = known[b, a] = pearson(scales[a], scales[b])
        return known[a, b]

    kept: list = []
    ordered = df_feat.orderBy(F.desc("abs_auc"), F.desc("abs_mean_dif"), "feature")
    for row in ordered.select("feature", "scale_id", "category", "positions", "abs_auc", "abs_mean_dif").toLocalIterator():
        at = set(",".join(map(str, row["positions"]))) if by_characters else set(row["positions"])
        clash = any((not check_category or k["category"] == row["category"]) and redundant(at, places, max_overlap) and cor(k["scale_id"], row["scale_id"]) > max_cor for k, places in kept)
        if not clash:
            kept.append((row, at))
        if len(kept) == n:
            break
    rows = [(i + 1, r["feature"], r["category"], r["abs_auc"], r["abs_mean_dif"]) for i, (r, _) in enumerate(kept)]
    return spark.createDataFrame(rows, "rank int, feature string, category string, abs_auc double, abs_mean_dif double")


def discover(values: DataFrame, scales: Mapping[str, Sequence[int]], metadata: DataFrame, positions: DataFrame, n: int = 100, max_std: float = 0.2, pct: float = 50) -> DataFrame:
    """The selection from values: moments of all features, the pre-filter's survivors, their rank statistics and p-values, redundancy."""
    moments = T.finalize_moments(T.group_moments(values))
    top = n_pre_filter(positions.count(), pct, n)
    survivors = prefilter(moments, max_std, top).select("feature", "mean_dif", "abs_mean_dif", "std_test", "std_ref")
    sums = T.mann_whitney(T.adjusted_auc(T.rank_sums(values.join(F.broadcast(survivors.select("feature")), "feature", "left_semi"))))
    tested = T.benjamini_hochberg(sums.withColumn("p_value", T.two_sided_p("z")))
    df_feat = with_scale_info(survivors.join(tested, "feature").join(positions.select("feature", "positions"), "feature"), metadata)
    chosen = greedy_redundancy(df_feat, scales, n)
    return chosen.join(df_feat.select("feature", "mean_dif", "std_test", "std_ref", "p_value", "p_fdr", "subcategory"), "feature")


#: Features whose sums are added up at once without looking for those that may pass.
MOST_ADDED = 4096


def may_pass(bounds: DataFrame, n: int) -> list[int]:
    """Numbers of the features that may be among the n with the largest difference: all but those below n others in any case."""
    bounds = bounds.persist()
    sure = [r["low"] for r in bounds.filter("sure").orderBy(F.desc("low")).select("low").limit(n).collect()]
    found = bounds if len(sure) < n or not n else bounds.filter(F.col("high") >= sure[-1])
    numbers = sorted(r["number"] for r in found.select("number").collect())
    bounds.unpersist()
    return numbers


def discover_wide(df_parts: DataFrame, parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]], metadata: DataFrame, n: int = 100, n_pre: int | None = None, max_std: float = 0.2, pct: float = 5, parametric: bool = False) -> DataFrame:
    """The selection among all parts x splits x scales, however many: sums of all features in one pass over ``df_parts(entry, label, parts)`` (of many features, bounds of all and then
    sums of those that may pass), then the rank statistics of the pre-filter's survivors only, then redundancy. Survivors are bounded by ``n_pre`` (by default ``pct`` percent of the
    features, ``n`` at least)."""
    from ..llm._common import cut

    names = list(scales)
    df_parts = df_parts.repartition(df_parts.sparkSession.sparkContext.defaultParallelism * 2)  # the parts are small next to the work that each row makes
    top = n_pre if n_pre is not None else n_pre_filter(len(parts) * len(splits) * len(names), pct, n)
    only = may_pass(X.matrix_bounds(df_parts, parts, splits, scales, max_std), top) if len(parts) * len(splits) * len(names) > MOST_ADDED else None
    moments = T.finalize_moments(X.matrix_moments(df_parts, parts, splits, scales, only=only))
    numbers = sorted(r["number"] for r in prefilter(moments, max_std, top).select("number").collect())
    stats = T.named_stats(T.stats_of_sums(X.matrix_sums(df_parts, parts, splits, scales, numbers), parametric), parametric)
    spark = df_parts.sparkSession
    per = len(splits) * len(names)
    places: dict[tuple[int, int], list[int]] = {}
    rows = []
    for k in numbers:
        part, split = k // per, k // len(names) % len(splits)
        if (part, split) not in places:
            places[part, split] = part_positions(parts[part], splits[split])
        rows.append((f"{parts[part].upper()}-{splits[split].label}-{names[k % len(names)]}", places[part, split]))
    at = spark.createDataFrame(rows, "feature string, positions array<int>")
    df_feat = cut(with_scale_info(stats.join(at, "feature"), metadata).filter("abs_auc IS NOT NULL"))
    chosen = greedy_redundancy(df_feat, scales, n)
    return chosen.join(df_feat.drop("category", "abs_auc", "abs_mean_dif"), "feature")


def prune_by_variance(values: DataFrame, key: str, value: str, threshold: float = 0.0) -> DataFrame:
    """``key, variance`` of the columns with a population variance above the threshold; constant ones have exactly 0."""
    stats = values.groupBy(key).agg(F.var_pop(value).alias("variance"), (F.max(value) - F.min(value)).alias("_range"))
    return stats.withColumn("variance", F.when(F.col("_range") == 0, 0.0).otherwise(F.col("variance"))).filter(F.col("variance") > threshold).select(key, "variance")


def column_correlations(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """``i, j, cor`` of all pairs i < j of a vector's components: each task adds up one matrix of products, whatever its rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            column = batch.column(0)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)[:, :dims]
            n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "n": np.full(len(i), float(n)), "si": s[i], "sj": s[j], "p": p[i, j]})

    parts = rows.select(vector).filter(F.col(vector).isNotNull()).mapInArrow(sums, "i long, j long, n double, si double, sj double, p double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "p")]).withColumn("c", F.col("p") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n"))
    own = total.filter("i = j").select(F.col("i").alias("d"), F.col("c").alias("v"))
    cross = total.filter("i < j").join(F.broadcast(own.toDF("i", "vi")), "i").join(F.broadcast(own.toDF("j", "vj")), "j")
    return cross.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.when(F.col("vi") * F.col("vj") > 0, F.col("c") / F.sqrt(F.col("vi") * F.col("vj"))).alias("cor"))


def greedy_correlation(pairs: DataFrame, dims: int, max_cor: float = 0.7) -> list[int]:
    """Columns in order; one goes if it correlates with a kept one (dims * dims / 2 numbers reach the driver)."""
    high = {(r["i"], r["j"]) for r in pairs.filter(F.abs("cor") > max_cor).collect()}
    kept: list[int] = []
    for j in range(dims):
        if not any((i, j) in high for i in kept):
            kept.append(j)
    return kept


def selection_frequency(values: DataFrame, n: int = 10, rounds: int = 8, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """``feature, frequency``: in which share of seeded resamples of the reference group a feature is among the n best by mean difference.

    A resample gives each reference entry a Poisson weight by its hash, so all rounds are one aggregate.
    """
    u = lambda b: (F.pmod(F.xxhash64(F.lit(seed), b, "entry"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    cumulative, weight, p = 0.0, F.lit(0), math.exp(-fraction)
    for k in range(6):
        cumulative += p
        weight = weight + F.when(u(F.col("_round")) > cumulative, 1).otherwise(0)
        p *= fraction / (k + 1)
    rows = values.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_w", F.when(F.col("label") == 1, 1).otherwise(weight))
    mean = lambda g: F.sum(F.when(F.col("label") == g, F.col("value") * F.col("_w"))) / F.sum(F.when((F.col("label") == g) & F.col("value").isNotNull(), F.col("_w")))
    dif = rows.groupBy("_round", "feature").agg(F.abs(mean(1) - mean(0)).alias("dif"))
    best = dif.withColumn("_r", F.row_number().over(Window.partitionBy("_round").orderBy(F.desc("dif"), "feature"))).filter(F.col("_r") <= n)
    return best.groupBy("feature").agg((F.count(F.lit(1)) / float(rounds)).alias("frequency"))


def top_features(df_feat: DataFrame, by: str, k: int) -> DataFrame:
    return df_feat.orderBy(F.desc(by), "feature").limit(k)


def importance_share(x: Column, total: Column) -> Column:
    """A value's share of the absolute total, in percent."""
    return F.abs(x) / total * 100
