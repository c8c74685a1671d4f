"""Queries over values per residue and over centres and fronts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.splits import segments
from ..operators import mutation as M
from ..operators import residues as R
from ..operators.stats import round_half_up as r
from .catalog import SEQ, load, query, rhu, sequences
from .encoding import DIMS, EMB
from .evaluation import _CENTERS


@query("residue_windows", f"WITH {SEQ}, w AS (SELECT entry, unnest(range(5, length(sequence) - 3)) AS pos, sequence FROM seq WHERE length(sequence) >= 9), x AS (SELECT substr(sequence, (pos - 4)::INT, 9) AS w, (substr(sequence, pos::INT, 1) = 'K')::INT AS label FROM w) SELECT substr(w, 1, 1) AS first, label, count(*) AS n FROM x GROUP BY 1, 2")
def residue_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of nine around every residue, labelled where a K stands, by first letter."""
    labels = F.array_join(F.transform(F.split("sequence", ""), lambda a: (a == "K").cast("int").cast("string")), ",")
    w = R.labelled_windows(sequences(spark, sf).select("entry", "sequence", labels.alias("labels")), 9)
    return w.groupBy(F.substring("window", 1, 1).alias("first"), F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


_SPANS = "iv AS (SELECT o_custkey, o_orderkey, (o_orderkey % 80 + 1)::INT AS a, (o_orderkey % 80 + o_orderkey % 17)::INT AS b, o_totalprice AS v FROM orders), ex AS (SELECT *, unnest(range(a, b + 1)) AS pos FROM iv WHERE b >= a)"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, sf, "orders").select("o_custkey", "o_orderkey", (key % 80 + 1).cast("int").alias("start"), (key % 80 + key % 17).cast("int").alias("stop"), "o_totalprice")


@query("annotation_encode", f"WITH {_SPANS} SELECT o_custkey, pos::INT AS pos, max_by(v, o_orderkey) AS value FROM ex GROUP BY 1, 2")
def annotation_encode(spark: SparkSession, sf: str) -> DataFrame:
    return R.annotate(_spans(spark, sf), "o_custkey", "o_orderkey", "o_totalprice").withColumnRenamed("o_totalprice", "value")


@query("domain_encode", f"WITH {_SPANS}, c AS (SELECT o_custkey, count(*) AS n FROM iv WHERE b >= a GROUP BY 1), f AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY o_custkey, pos ORDER BY o_orderkey) = 1) SELECT o_custkey, pos::INT AS pos, (pos = a OR pos = b)::INT AS boundary, {rhu('CASE WHEN b > a THEN (pos - a) / (b - a)::DOUBLE ELSE 0 END', 6)} AS relative, {rhu('(b - a + 1) / 200.0::DOUBLE', 6)} AS size, {rhu('n / 10.0::DOUBLE', 6)} AS n_domains FROM f JOIN c USING (o_custkey)")
def domain_encode(spark: SparkSession, sf: str) -> DataFrame:
    d = R.domain_values(_spans(spark, sf), "o_custkey", "o_orderkey")
    return d.withColumns({c: r(F.col(c), 6) for c in ("relative", "size", "n_domains")})


_THIRDS = ", ".join(f"('{s.label}', {s.positions(DIMS)[0] - 1}, {s.positions(DIMS)[-1] - 1})" for s in segments(1, 3))


@query("numeric_features", f"WITH {EMB}, sp(split, lo, hi) AS (VALUES {_THIRDS}) SELECT vec_id, split, {rhu('avg(value)', 6)} AS value FROM el JOIN sp ON dim BETWEEN lo AND hi GROUP BY 1, 2")
def numeric_features(spark: SparkSession, sf: str) -> DataFrame:
    """Segments over the numbers of each vector, taken as values of its positions."""
    return R.position_means(load(spark, sf, "embeddings"), "vec_id", "embedding", DIMS, segments(1, 3)).withColumn("value", r(F.col("value"), 6))


@query("cluster_correlation", f"WITH {_CENTERS} SELECT x.label AS a, y.label AS b, {rhu('corr(x.c, y.c)', 6)} AS correlation FROM ct x JOIN ct y ON x.dim = y.dim AND x.label < y.label GROUP BY 1, 2")
def cluster_correlation(spark: SparkSession, sf: str) -> DataFrame:
    c = R.center_correlations(load(spark, sf, "embeddings"), "label", "embedding", DIMS)
    return c.withColumn("correlation", r(F.col("correlation"), 6))


@query("least_correlation", f"WITH {_CENTERS}, k AS (SELECT el.vec_id, el.label, corr(value, c) AS k FROM el JOIN ct USING (label, dim) GROUP BY 1, 2) SELECT label, {rhu('min(k)', 6)} AS least FROM k GROUP BY label")
def least_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return R.least_center_correlation(load(spark, sf, "embeddings"), "label", "embedding", DIMS).withColumn("least", r(F.col("least"), 6))


@query("front_spread", f"WITH f AS (SELECT p_partkey, p_size AS x, p_retailprice AS y FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size >= p.p_size AND o.p_retailprice >= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice > p.p_retailprice))), g AS (SELECT coalesce(nullif((max(x) - min(x))::DOUBLE, 0), 1) AS sx, coalesce(nullif((max(y) - min(y))::DOUBLE, 0), 1) AS sy FROM f) SELECT {rhu('coalesce(avg(sqrt(((a.x - b.x) / sx) ** 2 + ((a.y - b.y) / sy) ** 2)), 0)', 6)} AS spread FROM f a JOIN f b ON a.p_partkey < b.p_partkey, g")
def front_spread(spark: SparkSession, sf: str) -> DataFrame:
    front = M.pareto_front(load(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"])
    return R.front_spread(front, ["p_size", "p_retailprice"]).select(r(F.col("spread"), 6).alias("spread"))
