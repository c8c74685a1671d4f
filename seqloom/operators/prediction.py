"""Predictions at the level of a sequence, a shifted domain or a window, their evaluation, and what is reported of their reliability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parts import window_offsets
from .metrics import conformal_sets, sharpness
from .models import fold_of


def linear_scores(values: DataFrame, weights: Mapping[str, float], bias: float, keys: Sequence[str]) -> DataFrame:
    """``keys, score``: the logistic of a weighted sum of feature values; missing values add nothing."""
    table = values.sparkSession.createDataFrame([(f, float(w)) for f, w in weights.items()], "feature string, _w double")
    return values.join(F.broadcast(table), "feature").groupBy(*keys).agg((1 / (1 + F.exp(-(F.coalesce(F.sum(F.col("value") * F.col("_w")), F.lit(0.0)) + bias)))).alias("score"))


def shifted_domains(df_seq: DataFrame, window: int = 3) -> DataFrame:
    """A row per entry and offset from -window to window with both bounds of the middle shifted; those outside the sequence go."""
    rows = df_seq.withColumn("offset", F.explode(F.sequence(F.lit(-window), F.lit(window))))
    rows = rows.withColumns({"tmd_start": F.col("tmd_start") + F.col("offset"), "tmd_stop": F.col("tmd_stop") + F.col("offset")})
    return rows.filter((F.col("tmd_start") >= 1) & (F.col("tmd_stop") <= F.length("sequence")))


def with_best(scores: DataFrame, by: str = "entry", order: str = "offset") -> DataFrame:
    """``is_best``: the highest score of each entry, the first by ``order`` where several are."""
    return scores.withColumn("is_best", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), order)) == 1)


def anchored_windows(df_seq: DataFrame, tmd_len: int, step: int = 1, jmd_n_len: int = 10, jmd_c_len: int = 10) -> DataFrame:
    """``entry, position, sequence, tmd_start, tmd_stop`` of a middle of ``tmd_len`` at every ``step``-th anchor that leaves room for both flanks; a row carries only
    the letters of its middle and flanks."""
    left, right = window_offsets(tmd_len)
    first, last = left + jmd_n_len + 1, F.length("sequence") - right + 1 - jmd_c_len
    rows = df_seq.select("entry", "sequence", F.explode(F.when(last >= first, F.sequence(F.lit(first), F.greatest(last, F.lit(first)), F.lit(step)))).alias("position"))
    cut = F.substring("sequence", F.col("position") - left - jmd_n_len, F.lit(jmd_n_len + tmd_len + jmd_c_len))
    return rows.select("entry", "position", cut.alias("sequence"), F.lit(jmd_n_len + 1).alias("tmd_start"), F.lit(jmd_n_len + tmd_len).alias("tmd_stop"))


MODELS = {
    "logistic": lambda: LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01),
    "forest": lambda: RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=20, maxDepth=5, seed=1),
}


def out_of_fold(df: DataFrame, key: str, vector: str, label: str, folds: int = 3, models: Sequence[str] = ("logistic",)) -> DataFrame:
    """``key, fold, model, y, score``: of each row the probability by a model that was fitted on the other folds."""
    x = df.select(key, F.col(label).cast("double").alias("y"), array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("x"), fold_of(key, folds).alias("fold"))
    out = None
    for f in range(folds):
        for name in models:
            got = MODELS[name]().fit(x.filter(F.col("fold") != f)).transform(x.filter(F.col("fold") == f))
            rows = got.select(key, "fold", F.lit(name).alias("model"), F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))
            out = rows if out is None else out.unionByName(rows)
    return out


def score_table(predictions: DataFrame, by: Sequence[str], score: str = "score", truth: str = "y", threshold: float = 0.5) -> DataFrame:
    """``by, metric, value``: accuracy, balanced accuracy, precision, recall, F1 and AUC of each group; a ratio without rows is 0."""
    hit, true = F.col(score) >= threshold, F.col(truth) == 1
    n = predictions.groupBy(*by, score).agg(F.count_if(hit & true).alias("_tp"), F.count_if(hit & ~true).alias("_fp"), F.count_if(~hit & true).alias("_fn"), F.count_if(~hit & ~true).alias("_tn"))
    ones, all_ = F.col("_tp") + F.col("_fn"), F.col("_tp") + F.col("_fn") + F.col("_fp") + F.col("_tn")
    before = F.coalesce(F.sum(all_).over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = n.withColumn("_r", (before * 2 + all_ + 1) * ones).groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in ("_tp", "_fp", "_fn", "_tn", "_r")])
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n1, n0 = tp + fn, fp + tn
    metrics = {
        "accuracy": ratio(tp + tn, n1 + n0), "balanced_accuracy": (ratio(tp, n1) + ratio(tn, n0)) / 2, "precision": ratio(tp, tp + fp), "recall": ratio(tp, n1),
        "f1": ratio(tp * 2, tp * 2 + fp + fn), "roc_auc": ratio(F.col("_r") / 2 - n1 * (n1 + 1) / 2, n1 * n0),
    }
    return sums.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()])).alias("_m")).select(*by, "_m.metric", "_m.value")


def aggregate_scores(scores: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """``by, score, score_std, n_scores``: mean and population deviation of fold scores."""
    return scores.groupBy(*by).agg(F.avg(value).alias("score"), F.stddev_pop(value).alias("score_std"), F.count(F.lit(1)).alias("n_scores"))


def baseline_scores(df: DataFrame, truth: str = "y") -> DataFrame:
    """One row: what a guess of the more frequent class, and one by the classes' shares, get right."""
    p = F.avg(F.col(truth).cast("double"))
    return df.agg(F.greatest(p, 1 - p).alias("majority"), (p * p + (1 - p) * (1 - p)).alias("stratified"))


def calibration_table(predictions: DataFrame, bins: int = 10, score: str = "score", truth: str = "y") -> DataFrame:
    """``low, high, rate`` of equal-width bins, made not to fall from bin to bin (the running maximum of the rates)."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    rates = predictions.groupBy(b.alias("bin")).agg(F.avg(F.col(truth).cast("double")).alias("_r"))
    up = F.max("_r").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rates.select((F.col("bin") / float(bins)).alias("low"), ((F.col("bin") + 1) / float(bins)).alias("high"), up.alias("rate"))


def reliability_report(rounds: DataFrame, key: str, threshold: Column, ci: float = 90.0, score: str = "score") -> DataFrame:
    """``key, score, score_std, ci_low, ci_high, margin, entropy, conformal_set`` from scores of several rounds (``rounds(key, score)``)."""
    a = (100 - ci) / 200
    one = rounds.groupBy(key).agg(F.avg(score).alias("score"), F.stddev_pop(score).alias("score_std"), F.percentile(score, a).alias("ci_low"), F.percentile(score, 1 - a).alias("ci_high"))
    margin, entropy = sharpness(F.col("score"))
    return one.select("*", margin.alias("margin"), entropy.alias("entropy"), conformal_sets(F.col("score"), threshold).alias("conformal_set"))
