"""Queries over clusters, reliable negatives, models and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from .catalog import load, query
from .encoding import DIMS


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y"), F.when(F.col("label") == 0, 1).otherwise(2).alias("pu"))


@query("aaclust_fit")
def aaclust_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters in which every vector correlates with its centre."""
    return M.optimal_clusters(_vectors(spark, sf), "vec_id", "embedding", 0.3).select("vec_id", "cluster")


@query("pu_pca")
def pu_pca(spark: SparkSession, sf: str) -> DataFrame:
    return M.negatives_by_components(_vectors(spark, sf), "vec_id", "embedding", "pu", DIMS, 40)


@query("fold_scores")
def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    return M.fold_scores(_vectors(spark, sf), "vec_id", "embedding", "y")


@query("tree_model")
def tree_model(spark: SparkSession, sf: str) -> DataFrame:
    return M.importances(_vectors(spark, sf), "embedding", "y")


@query("tree_predict")
def tree_predict(spark: SparkSession, sf: str) -> DataFrame:
    return M.predict(_vectors(spark, sf), "vec_id", "embedding", "y")


@query("recursive_elimination")
def recursive_elimination(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d in M.eliminate(_vectors(spark, sf), "embedding", "y", 16)], "dim int")


@query("applicability_domain")
def applicability_domain(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return M.applicability(v, v.filter("y = 1"), "vec_id", "embedding")
