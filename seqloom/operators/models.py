"""Clusters, reliable negatives, models and their reliability: distributed sums and MLlib, small matrices on the driver."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import pearson


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays of one length."""
    n = F.size(a).cast("double")
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    times = lambda x, y: add(F.zip_with(x, y, lambda u, v: u * v))
    ma, mb = add(a) / n, add(b) / n
    low = F.sqrt((times(a, a) - n * ma * ma) * (times(b, b) - n * mb * mb))
    return F.when(low > 0, (times(a, b) - n * ma * mb) / low).otherwise(0.0)


def clusters(df: DataFrame, key: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    """``key, vector, cluster, center``."""
    x = df.select(key, F.transform(vector, lambda v: v.cast("double")).alias(vector)).withColumn("_x", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster", maxIter=10).fit(x)
    at = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    return model.transform(x).join(F.broadcast(at), "cluster").select(key, vector, "cluster", "center")


def least_correlation(clustered: DataFrame, vector: str) -> float:
    """The least correlation of any row to its centre (clusters of one don't count)."""
    row = clustered.withColumn("_n", F.size(vector)).agg(F.min(correlation(F.col(vector), F.col("center")))).first()
    return float(row[0]) if row[0] is not None else 1.0


#: Rows of a table whose clusters are fitted as a whole, and about how many are divided in one task.
FITTED, _TOGETHER = 4_000, 2_000


def _row_correlation(x: np.ndarray) -> np.ndarray:
    """Correlation of each row with the mean of all."""
    c, y = x.mean(axis=0) - x.mean(), x - x.mean(axis=1, keepdims=True)
    low = np.sqrt((y * y).sum(axis=1) * (c * c).sum())
    return np.where(low > 0, (y @ c) / np.maximum(low, 1e-300), 0.0)


def divide(x: np.ndarray, least: float) -> np.ndarray:
    """Numbers of clusters in which every row correlates with its centre: a cluster with a row that doesn't is divided in two. Rows alone, and equal rows, stay."""
    out, found, todo = np.zeros(len(x), dtype=np.int64), 0, [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        mine = x[rows]
        q = _row_correlation(mine)
        side = None
        if len(rows) > 1 and q.min() < least:
            one = mine[int(q.argmin())]
            other = mine[int(((mine - one) ** 2).sum(axis=1).argmax())]
            for _ in range(10):
                new = ((mine - one) ** 2).sum(axis=1) > ((mine - other) ** 2).sum(axis=1)
                if not 0 < new.sum() < len(new) or (side is not None and (new == side).all()):
                    break
                side, one, other = new, mine[~new].mean(axis=0), mine[new].mean(axis=0)
        if side is None:
            out[rows] = found
            found += 1
        else:
            todo += [rows[side], rows[~side]]
    return out


def divided_clusters(df: DataFrame, key: str, vector: str, least: float, rows: int, seed: int = 1) -> DataFrame:
    """``key, vector, cluster, center``: one fit of about a cluster for ``_TOGETHER`` rows, each of which a task divides until every row correlates with its centre. The work
    of the divisions grows with the rows times their depth."""
    from ..llm._common import cut

    kind = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        local = divide(x, least)
        n = np.bincount(local)
        sums = np.zeros((len(n), x.shape[1]))
        np.add.at(sums, local, x)
        means = sums / n[:, None]
        return pd.DataFrame({key: pdf[key], vector: list(x), "_part": pdf["cluster"], "_local": local, "center": list(means[local])})

    coarse = clusters(df, key, vector, max(2, -(-rows // _TOGETHER)), seed).select(key, vector, "cluster")
    fine = cut(coarse.groupBy("cluster").applyInPandas(run, f"`{key}` {kind}, `{vector}` array<double>, _part int, _local long, center array<double>"))
    many = sorted((r[0], r[1]) for r in fine.groupBy("_part").agg(F.max("_local") + 1).collect())
    firsts, total = [], 0
    for part, n in many:
        firsts.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(firsts, "_part int, _first long")
    return fine.join(F.broadcast(table), "_part").select(key, vector, (F.col("_first") + F.col("_local")).cast("int").alias("cluster"), "center")


def optimal_clusters(df: DataFrame, key: str, vector: str, least: float = 0.3, most: int | None = None, seed: int = 1) -> DataFrame:
    """The fewest clusters, among doublings and then halvings of the step, in which every row correlates with its centre.

    Each trial is one distributed fit over the persisted vectors; there are log(most) + 3 trials at most (``most``: the number of rows, or
    fewer). If even so many clusters don't do, a warning says so. Without ``most``, tables of more than ``FITTED`` rows are divided (``divided_clusters``): the number of
    clusters grows with the rows, so a fit of all to all would grow with their square.
    """
    df = df.select(key, vector).persist()
    rows = df.count()
    if most is None and rows > FITTED:
        out = divided_clusters(df, key, vector, least, rows, seed)
        df.unpersist()
        return out
    most = rows if most is None else most
    low, k = 1, 2
    best = clusters(df, key, vector, k, seed)
    while least_correlation(best, vector) < least and k < most:
        low, k = k, min(2 * k, most)
        best = clusters(df, key, vector, k, seed)
    if least_correlation(best, vector) < least:
        warnings.warn(f"with {k} clusters some rows still correlate with their centre below {least}", stacklevel=2)
        return best
    high = k
    while high - low > max(1, high // 4):
        middle = (low + high) // 2
        trial = clusters(df, key, vector, middle, seed)
        if least_correlation(trial, vector) >= least:
            high, best = middle, trial
        else:
            low = middle
    return best


def gram(df: DataFrame, vector: str, dims: int) -> np.ndarray:
    """Sum over rows of x x', each row freed of its own mean: dims x dims numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            x = x - x.mean(axis=1, keepdims=True)
            total += x.T @ x
        i, j = np.indices((dims, dims))
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    out = np.zeros((dims, dims))
    for r in df.select(vector).mapInArrow(sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def negatives_by_components(df: DataFrame, key: str, vector: str, label: str, dims: int, n: int, share: float = 0.8) -> DataFrame:
    """``key, component, deviation``: n unlabelled rows (label 2) whose coordinates are farthest from the mean of the positives (label 1).

    Rows are the variables of the principal components, so the coordinates come from the eigenvectors of a dims x dims matrix. Each
    component gives negatives by its part of the variance, first come first served.
    """
    values, vectors = np.linalg.eigh(gram(df, vector, dims))
    order = np.argsort(-values)
    parts = values[order] / values.sum()
    use = int(np.searchsorted(np.cumsum(parts), share) + 1)
    x = F.transform(vector, lambda v: v.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / dims
    dot = lambda u: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in u]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - mean * float(u.sum())
    coords = df.select(key, label, *[(dot(vectors[:, order[k]]) / math.sqrt(max(values[order[k]], 1e-300))).alias(f"_p{k}") for k in range(use)])
    centre = coords.filter(F.col(label) == 1).agg(*[F.avg(f"_p{k}") for k in range(use)]).first()
    chosen: dict = {}
    for k in range(use):
        want = min(math.ceil(n * parts[k] / parts[:use].sum()), n - len(chosen))
        if want <= 0:
            break
        far = coords.filter(F.col(label) == 2).select(key, F.abs(F.col(f"_p{k}") - F.lit(centre[k])).alias("_d")).orderBy(F.desc("_d"), key).limit(want + len(chosen))
        for r in [r for r in far.collect() if r[key] not in chosen][:want]:
            chosen[r[key]] = (k, float(r["_d"]))
    return df.sparkSession.createDataFrame([(i, k, d) for i, (k, d) in chosen.items()], f"{key} {dict(df.dtypes)[key]}, component int, deviation double")


def fold_of(key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(folds)).cast("int")


def fold_scores(df: DataFrame, key: str, vector: str, label: str, folds: int = 3) -> DataFrame:
    """``fold, model, n, accuracy, recall, precision`` of models fitted on the other folds."""
    x = df.select(key, F.col(label).cast("double").alias("y"), array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("x"), fold_of(key, folds).alias("fold"))
    models = {"logistic": LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01), "forest": RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=20, maxDepth=5, seed=1)}
    out = None
    for f in range(folds):
        for name, model in models.items():
            got = model.fit(x.filter(F.col("fold") != f)).transform(x.filter(F.col("fold") == f))
            hit, true = F.col("prediction") == 1, F.col("y") == 1
            row = got.agg(F.count(F.lit(1)).alias("n"), F.avg((hit == true).cast("double")).alias("accuracy"), (F.count_if(hit & true) / F.count_if(true)).alias("recall"), F.try_divide(F.count_if(hit & true), F.count_if(hit)).alias("precision"))
            row = row.select(F.lit(f).alias("fold"), F.lit(name).alias("model"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def predict(df: DataFrame, key: str, vector: str, label: str, rounds: int = 3) -> DataFrame:
    """``key, mean, std`` of the probabilities of forests with different seeds."""
    x = df.select(key, F.col(label).cast("double").alias("y"), array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("x"))
    p = []
    for s in range(rounds):
        model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=15, maxDepth=5, seed=s, probabilityCol=f"_q{s}", rawPredictionCol=f"_r{s}", predictionCol=f"_c{s}").fit(x)
        x = model.transform(x).withColumn(f"_p{s}", vector_to_array(f"_q{s}")[1])
        p.append(F.col(f"_p{s}"))
    mean = sum(p, F.lit(0.0)) / rounds
    return x.select(key, mean.alias("mean"), F.sqrt(F.greatest(sum((c * c for c in p), F.lit(0.0)) / rounds - mean * mean, F.lit(0.0))).alias("std"))


def importances(df: DataFrame, vector: str, label: str, rounds: int = 3) -> DataFrame:
    """``dim, importance, std`` (percent) averaged over forests with different seeds."""
    x = df.select(F.col(label).cast("double").alias("y"), array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("x"))
    found = np.array([RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=20, maxDepth=5, seed=s).fit(x).featureImportances.toArray() for s in range(rounds)]) * 100
    return df.sparkSession.createDataFrame([(i, float(m), float(s)) for i, (m, s) in enumerate(zip(found.mean(axis=0), found.std(axis=0), strict=True))], "dim int, importance double, std double")


def eliminate(df: DataFrame, vector: str, label: str, keep: int, step: int = 16) -> list[int]:
    """Recursive elimination: the least important dimensions go, ``step`` at a time, until ``keep`` are left."""
    dims = list(range(len(df.select(vector).first()[0])))
    while len(dims) > keep:
        part = df.select(label, F.array(*[F.col(vector)[d] for d in dims]).alias(vector))
        ranked = importances(part, vector, label, rounds=1).orderBy("importance", F.desc("dim")).limit(min(step, len(dims) - keep)).collect()
        gone = {dims[r["dim"]] for r in ranked}
        dims = [d for d in dims if d not in gone]
    return dims


def applicability(df: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 5, percentile: float = 95.0, block: int = 1024) -> DataFrame:
    """``key, distance, ood``: mean distance to the k nearest other reference rows (fewer if there are no more), after scaling by the means and
    deviations of all reference rows, and its ratio to the percentile of the reference rows' own (no number if that is 0).

    Blocks of ``block`` rows meet block by block; each meeting hands on k distances a row."""
    scale = reference.select(F.posexplode(F.transform(vector, lambda v: v.cast("double"))).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("d").collect()
    mean, std = np.array([r["m"] for r in scale]), np.array([r["s"] if r["s"] > 0 else 1.0 for r in scale])
    n = reference.count()
    k = max(1, min(k, n - 1))

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        rows = rows.select(F.struct(F.col(key).alias("k"), F.transform(vector, lambda v: v.cast("double")).alias("v")).alias("r"), F.pmod(F.xxhash64(key), F.lit(max(1, -(-size // block)))).alias("b"))
        return rows.groupBy("b").agg(F.collect_list("r").alias("r")).select(F.col("r.k").alias(f"{name}k"), F.col("r.v").alias(f"{name}v"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, theirs = batch.column("qk")[i].values, batch.column("rk")[i].values
                q, z = ((batch.column(c)[i].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean) / std for c in ("qv", "rv"))
                d = np.sqrt(np.maximum((q**2).sum(1)[:, None] - 2 * q @ z.T + (z**2).sum(1), 0))
                d[ids.to_numpy(zero_copy_only=False)[:, None] == theirs.to_numpy(zero_copy_only=False)[None, :]] = np.inf
                top = np.sort(d, axis=1)[:, :k].tolist()
                yield pa.RecordBatch.from_pydict({key: ids, "top": pa.array([[x for x in row if x < np.inf] for row in top], pa.list_(pa.float64()))})

    known = blocks(reference, n, "r")

    def nearest(rows: DataFrame, size: int) -> DataFrame:
        met = blocks(rows, size, "q").crossJoin(known).mapInArrow(meet, f"{key} {dict(df.dtypes)[key]}, top array<double>")
        top = met.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        return top.select(key, (F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("top"), F.lit(0))).alias("distance"))

    threshold = nearest(reference, n).agg(F.percentile("distance", F.lit(percentile / 100))).first()[0]
    return nearest(df, df.count()).withColumn("ood", F.col("distance") / threshold if threshold else F.lit(float("nan")))


def swap_scales(features: Sequence[tuple[str, float]], scales: Mapping[str, Sequence[float]], grade: Mapping[str, int], least: float = 0.7) -> dict[str, str]:
    """For each feature's scale the best graded one (smaller is better) that correlates with it; its own if there is none."""
    out = {}
    for name, _ in features:
        own = name.rsplit("-", 1)[1]
        better = [(grade[s], -abs(pearson(scales[own], scales[s])), s) for s in scales if s != own and grade[s] < grade[own] and abs(pearson(scales[own], scales[s])) >= least]
        out[name] = min(better)[2] if better else own
    return out


def simplest_of_best(configs: DataFrame, quality: str, size: str) -> DataFrame:
    """The configurations that none beats in both quality (greater) and size (smaller), the best quality first."""
    other = configs.select(F.col(quality).alias("_q"), F.col(size).alias("_s")).distinct()
    beaten = (F.col("_q") >= F.col(quality)) & (F.col("_s") <= F.col(size)) & ((F.col("_q") > F.col(quality)) | (F.col("_s") < F.col(size)))
    return configs.join(F.broadcast(other), beaten, "left_anti").orderBy(F.desc(quality), size)
