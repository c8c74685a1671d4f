"""Clusters, negatives, models and selection on small data."""

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import embeddings as E
from seqloom.operators import models as M
from seqloom.operators import select as S


def vectors(spark, n=60, dims=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + np.repeat(np.eye(dims)[:2] * 6, n // 2, axis=0)
    rows = [(i, v.tolist(), int(i < n // 2), 1 if i < n // 4 else 2) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "k long, v array<double>, y int, pu int")


def test_clusters_and_gram(spark):
    x, df = vectors(spark)
    own = x - x.mean(axis=1, keepdims=True)
    assert np.allclose(M.gram(df, "v", 6), own.T @ own)
    got = M.clusters(df, "k", "v", 2)
    assert got.groupBy("cluster").agg(F.countDistinct(F.col("k") < 30).alias("n")).filter("n > 1").count() == 0
    assert M.negatives_by_components(df, "k", "v", "pu", 6, 10).filter("k < 15").count() == 0


def test_models(spark):
    _, df = vectors(spark)
    assert M.fold_scores(df, "k", "v", "y").agg(F.min("accuracy")).first()[0] > 0.8
    top = M.importances(df, "v", "y").orderBy(F.desc("importance")).limit(2).collect()
    assert {r["dim"] for r in top} == {0, 1} and set(M.eliminate(df, "v", "y", 2, 2)) == {0, 1}
    far = M.applicability(df, df.filter("y = 1"), "k", "v")
    assert far.filter("k >= 30").agg(F.min("ood")).first()[0] > far.filter("k < 30").agg(F.avg("ood")).first()[0]


def test_applicability_of_all_reference_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2600, 3)) * [1, 5, 0.1] + rng.integers(0, 4, (2600, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    z = (x - x[:2500].mean(0)) / x[:2500].std(0)
    d = np.sqrt(((z[:, None] - z[None, :2500]) ** 2).sum(2))
    d[np.arange(2500), np.arange(2500)] = np.inf
    want = np.sort(d, axis=1)[:, :5].mean(1)
    got = M.applicability(df, df.filter("k < 2500"), "k", "v").orderBy("k").collect()
    assert np.allclose([r["distance"] for r in got], want, atol=1e-5)
    assert np.allclose([r["ood"] for r in got], want / np.percentile(want[:2500], 95), atol=1e-4)


def test_clusters_double_until_all_correlate(spark):
    x = np.random.default_rng(5).normal(size=(300, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = M.optimal_clusters(df, "k", "v", 0.6)
    assert M.least_correlation(got, "v") >= 0.6 and got.select("cluster").distinct().count() > 128


def test_correlations_and_scaling(spark):
    x, df = vectors(spark)
    cor = np.corrcoef(x.T)
    assert all(abs(r["cor"] - cor[r["i"], r["j"]]) < 1e-9 for r in S.column_correlations(df.select("v"), "v", 6).collect())
    scaled = np.array([r["v"] for r in E.encode(df.select("k", "v"), "v", 6).orderBy("k").collect()])
    assert np.allclose(scaled, (x - x.min(0)) / (x.max(0) - x.min(0)))


def test_queries_take_all_dimensions_and_positions(spark, tmp_path):
    from seqloom.plans import design, encoding

    h = np.ones((1, 1))
    while len(h) < encoding.DIMS:
        h = np.block([[h, h], [h, -h]])
    h[:, 63] = h[:, 62]
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(h)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r["dim"] for r in encoding.prune_correlation(spark, str(tmp_path)).collect()] == list(range(63))
    wild = "ACDEFGHIKLMNPQRSTVWY" * 4
    spark.createDataFrame([(1, wild)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert any(r["sequence"][40:] != wild[40:] for r in design.evolve_variants(spark, str(tmp_path)).collect())


def test_swap_and_choice(spark):
    scales = {"a": [1, 2, 3], "b": [2, 4, 6], "c": [3, 1, 2]}
    assert M.swap_scales([("T-S-b", 0), ("T-S-c", 0)], scales, {"a": 0, "b": 1, "c": 2}) == {"T-S-b": "a", "T-S-c": "c"}
    configs = spark.createDataFrame([("x", 0.5, 4), ("y", 0.5, 3), ("z", 0.4, 5), ("w", 0.3, 1)], "c string, q double, n int")
    assert [r["c"] for r in M.simplest_of_best(configs, "q", "n").collect()] == ["y", "w"]


def test_many_rows_are_divided_until_they_correlate(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from seqloom.operators import models as M

    monkeypatch.setattr(M, "FITTED", 100)
    monkeypatch.setattr(M, "_TOGETHER", 80)
    x = np.random.default_rng(1).normal(size=(300, 8))
    x[50:60] = x[50]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>")
    out = M.optimal_clusters(df, "k", "v", 0.3)
    rows = out.collect()
    assert sorted(r.k for r in rows) == list(range(300)) and {r.cluster for r in rows} == set(range(max(r.cluster for r in rows) + 1))
    assert M.least_correlation(out, "v") >= 0.3 - 1e-9 and 1 < out.select("cluster").distinct().count() < 200
    for c in {r.cluster for r in rows}:
        mine = [r for r in rows if r.cluster == c]
        assert np.allclose(mine[0].center, x[[r.k for r in mine]].mean(axis=0))


def test_clusters_of_long_tables_merge_as_those_of_short_ones(spark, monkeypatch):
    import numpy as np

    from seqloom.operators import choice as C

    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    label = [int(v) for v in rng.integers(0, 90, 200)]
    x = base[np.array(label) % 6] + rng.normal(size=(200, 8)) * 0.6
    df = spark.createDataFrame([(i, [float(v) for v in r], c) for i, (r, c) in enumerate(zip(x, label, strict=True))], "k long, v array<double>, c int")
    want = [tuple(r) for r in C.merged(df, "k", "v", "c", 4, 0.2).orderBy("k").collect()]
    monkeypatch.setattr(C, "MOST_MERGED", 50)
    assert [tuple(r) for r in C.merged(df, "k", "v", "c", 4, 0.2).orderBy("k").collect()] == want
    assert len({c for _, c in want}) < len(set(label))
