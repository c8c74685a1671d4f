"""Whole workflows: search for a feature set, samples for a task, models over feature sets, and the fit / transform form of discovery."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parts import get_parts
from ..functions.splits import Split
from . import matrix as X
from . import select as S
from .models import simplest_of_best
from .simplify import centroid_accuracy, number_of


def feature_values_of(df_parts: DataFrame, parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]], features: Sequence[str], keep: Sequence[str] = ("entry", "label")) -> DataFrame:
    """Long values of chosen features only."""
    return X.matrix_values(df_parts, parts, splits, scales, keep, [number_of(f, parts, splits, list(scales)) for f in features])


@dataclass
class Discovery:
    """Discovery as fit and transform: ``fit`` selects features on labelled sequences, ``transform`` gives their values, a column each."""

    parts: Sequence[str]
    splits: Sequence[Split]
    scales: Mapping[str, Sequence[int]]
    metadata: DataFrame
    n: int = 20
    n_pre: int = 200
    max_std: float = 0.2
    features: list[str] = field(default_factory=list)

    def fit(self, df_seq: DataFrame) -> Discovery:
        df_parts = get_parts(df_seq, tuple(self.parts), keep=("entry", "label"))
        chosen = S.discover_wide(df_parts, self.parts, self.splits, self.scales, self.metadata, self.n, self.n_pre, self.max_std)
        self.features = [r["feature"] for r in chosen.orderBy("rank").collect()]
        return self

    def transform(self, df_seq: DataFrame) -> DataFrame:
        """``entry`` and a column per feature, named f1, f2, ... in the order of ``features``."""
        values = feature_values_of(get_parts(df_seq, tuple(self.parts)), self.parts, self.splits, self.scales, self.features, ("entry",))
        names = {f: f"f{k + 1}" for k, f in enumerate(self.features)}
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        return values.withColumn("_f", F.element_at(table, F.col("feature"))).groupBy("entry").pivot("_f", list(names.values())).agg(F.first("value"))


def find_features(df_seq: DataFrame, configs: Mapping[str, tuple[Sequence[str], Sequence[Split]]], scales: Mapping[str, Sequence[int]], metadata: DataFrame, n: int = 20, n_pre: int = 200, folds: int = 3) -> DataFrame:
    """``config, n_features, accuracy`` of the configurations (parts and splits) that none beats in both, by features discovered and judged across folds: each configuration is one discovery and
    one cross-validated score."""
    rows = []
    for name, (parts, splits) in configs.items():
        found = Discovery(parts, splits, scales, metadata, n, n_pre).fit(df_seq)
        values = feature_values_of(get_parts(df_seq, tuple(parts), keep=("entry", "label")), parts, splits, scales, found.features)
        rows.append((name, len(found.features), float(centroid_accuracy(values, folds))))
    table = df_seq.sparkSession.createDataFrame(rows, "config string, n_features int, accuracy double")
    return simplest_of_best(table, "accuracy", "n_features")


def evaluate_sets(df_seq: DataFrame, sets: Mapping[str, Sequence[str]], parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]], folds: int = 3, score: Callable[[DataFrame, int], float] = centroid_accuracy) -> DataFrame:
    """``name, n_features, score`` of feature sets, each judged across folds (four digits)."""
    df_parts = get_parts(df_seq, tuple(parts), keep=("entry", "label"))
    rows = [(name, len(features), round(score(feature_values_of(df_parts, parts, splits, scales, features), folds), 4)) for name, features in sets.items()]
    return df_seq.sparkSession.createDataFrame(rows, "name string, n_features int, score double")


def obtain_samples(positives: DataFrame, negatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of a task, positives labelled 1 and negatives 0, and their balance: ``label, n, share``."""
    rows = positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)), allowMissingColumns=True)
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    return rows, counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("_all")).alias("share"))
