"""Queries over whole workflows: simplification, search, fit and transform, samples, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import parts as P
from ..functions.alphabet import scale_metadata, scale_values
from ..operators import pipelines as L
from ..operators import simplify as Y
from ..operators import windows as W
from ..operators.stats import round_half_up as r
from .catalog import PARTS, SCALES, SEGMENTS, labelled, load, query, rhu
from .core import _df_feat
from .design import POS, SIZE, positioned

MANY = {f"SC{s:02d}": scale_values(s) for s in range(40)}
GRADES = {s: i % 10 for i, s in enumerate(MANY)}


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return P.get_parts(labelled(spark, sf), PARTS, keep=("entry", "label"))


@query("simplify_swap")
def simplify_swap(spark: SparkSession, sf: str) -> DataFrame:
    """All features of the statistics frame, with scales swapped for better graded ones, and their statistics."""
    return Y.swap_all(_df_feat(spark, sf).select("feature"), _parts(spark, sf), PARTS, SEGMENTS, MANY, GRADES, 0.5)


@query("simplify_greedy")
def simplify_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """The six best features, swapped one by one as long as the cross-validated accuracy holds."""
    best = [x["feature"] for x in _df_feat(spark, sf).orderBy(F.desc("abs_auc"), "feature").limit(6).collect()]
    parts = _parts(spark, sf).persist()
    kept, _ = Y.greedy(best, MANY, GRADES, lambda fs: Y.centroid_accuracy(L.feature_values_of(parts, PARTS, SEGMENTS, MANY, fs)), 0.6, 0.02)
    parts.unpersist()
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query("find_features")
def find_features(spark: SparkSession, sf: str) -> DataFrame:
    """The configurations of parts and splits that none beats in both accuracy across folds and number of features."""
    configs = {"tmd": (("tmd",), SEGMENTS[:3]), "tmd_flanks": (PARTS, SEGMENTS[:1]), "all": (PARTS, SEGMENTS)}
    return L.find_features(labelled(spark, sf), configs, SCALES, scale_metadata(spark, len(SCALES)), 10, 40)


@query("evaluate_feature_sets")
def evaluate_feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy across folds of two feature sets."""
    ranked = [x["feature"] for x in _df_feat(spark, sf).orderBy(F.desc("abs_auc"), "feature").limit(20).collect()]
    return L.evaluate_sets(labelled(spark, sf), {"best": ranked[:10], "next": ranked[10:]}, PARTS, SEGMENTS, SCALES)


@query("discovery_transform")
def discovery_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Discovery fitted on labelled sequences, and the values of its features, a column each."""
    seq = labelled(spark, sf)
    return L.Discovery(PARTS, SEGMENTS, SCALES, scale_metadata(spark, len(SCALES)), 5, 30).fit(seq).transform(seq)


@query("obtain_samples", f"WITH {POS}, p AS (SELECT 1 AS label FROM ps, unnest(pos) u(c) WHERE c >= 5 AND c <= length(sequence) - 4), b AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY md5(concat_ws(':', '0', entry, c)), c) AS place, md5(concat_ws(':', '0', entry, c)) AS h FROM cand WHERE d BETWEEN 3 AND 20), n AS (SELECT 0 AS label FROM (SELECT * FROM b ORDER BY place, h, entry, c LIMIT 200)), s AS (SELECT * FROM p UNION ALL SELECT * FROM n) SELECT label, count(*) AS n, {rhu('count(*) / sum(count(*)) OVER ()::DOUBLE', 8)} AS share FROM s GROUP BY label")
def obtain_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Windows at positions, windows near them as negatives, and how balanced the task is."""
    base = positioned(spark, sf).filter(F.size("pos") > 0)
    at = W.cut_windows(base.withColumn("center", F.explode("pos")).filter((F.col("center") >= 5) & (F.col("center") <= F.length("sequence") - 4)), SIZE)
    near = W.draw_per_protein(base, SIZE, 200, min_distance=3, max_distance=20)
    _, balance = L.obtain_samples(at.select("entry", "center", "window"), near.select("entry", "center", "window"))
    return balance.withColumn("share", r(F.col("share"), 8))


@query("provenance_hash")
def provenance_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and content hash of the orders, the same in any order and number of partitions."""
    return session.content_hash(load(spark, sf, "orders"))
