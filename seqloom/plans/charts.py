"""The frames that charts of predictions, mutations, variants and fronts are drawn from, and queries over explanations and generated windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS, scales_table
from ..operators import explain as E
from ..operators import frames as R
from ..operators import matrix as X
from ..operators import mutation as U
from ..operators.stats import round_half_up as r
from .catalog import SCALES, SEQ, features_sql, load, query, rhu, sequences
from .core import DF_FEAT, _df_feat
from .design import SCAN, SCANNED, positioned
from .encoding import EMB, SCALE_ROWS
from .extended import _HALVES, _PRED, WEIGHTS, _predictions


@query("chart_feature_map", f"WITH {DF_FEAT}, s AS (SELECT *, 'sub' || (substr(split_part(feature, '-', 3), 3)::INT % 5) AS subcategory FROM df_feat) SELECT subcategory, count(*) AS n_features, {rhu('sum(abs_auc) / sum(sum(abs_auc)) OVER () * 100', 6)} AS share FROM s GROUP BY subcategory")
def chart_feature_map(spark: SparkSession, sf: str) -> DataFrame:
    """The bars beside a map of features: each subcategory's part of the whole, in percent."""
    d = _df_feat(spark, sf).groupBy("subcategory").agg(F.count(F.lit(1)).alias("n_features"), F.sum("abs_auc").alias("s"))
    return d.select("subcategory", "n_features", r(F.col("s") / F.sum("s").over(Window.partitionBy(F.lit(0))) * 100, 6).alias("share"))


@query("chart_structure_map", f"WITH {DF_FEAT}, v AS (SELECT unnest(ats)::INT AS pos, mean_dif / len(ats) AS x FROM df_feat), s AS (SELECT pos, sum(x) AS x FROM v GROUP BY pos) SELECT pos, {rhu('x / max(abs(x)) OVER ()', 7)} AS color FROM s")
def chart_structure_map(spark: SparkSession, sf: str) -> DataFrame:
    """What residues of a structure are coloured by: signed values per position, scaled to -1..1."""
    v = _df_feat(spark, sf).select(F.explode("positions").alias("pos"), (F.col("mean_dif") / F.size("positions")).alias("x")).groupBy("pos").agg(F.sum("x").alias("x"))
    return v.select("pos", r(F.col("x") / F.max(F.abs("x")).over(Window.partitionBy(F.lit(0))), 7).alias("color"))


@query("chart_prediction_ranks", f"WITH {_PRED}, g AS (SELECT fold, score, y FROM pr) SELECT fold, y, {rhu('score', 6)} AS score, count(*) AS n, (rank() OVER (PARTITION BY fold ORDER BY score DESC, y))::INT AS rank FROM g GROUP BY fold, y, score")
def chart_prediction_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Scores in order, with their classes."""
    g = _predictions(spark, sf).groupBy("fold", "y", "score").agg(F.count(F.lit(1)).alias("n"))
    return g.select("fold", "y", r(F.col("score"), 6).alias("score"), "n", F.rank().over(Window.partitionBy("fold").orderBy(F.desc("score"), "y")).alias("rank"))


@query("chart_prediction_groups", f"WITH {_PRED} SELECT y, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'middle' ELSE 'low' END AS band, count(*) AS n, {rhu('count(*) / sum(count(*)) OVER (PARTITION BY y)::DOUBLE', 8)} AS share FROM pr GROUP BY 1, 2")
def chart_prediction_groups(spark: SparkSession, sf: str) -> DataFrame:
    """How the scores of each class fall into bands."""
    from ..operators.labels import score_group

    g = _predictions(spark, sf).groupBy("y", score_group(F.col("score"), [0.5, 0.8], ["low", "middle", "high"]).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("y")), 8))


@query("chart_reliability_ranking", f"WITH {_PRED} SELECT fold, {rhu('avg(abs(score - 0.5::DOUBLE) * 2)', 7)} AS margin, {rhu('avg(((score >= 0.5)::INT = y)::INT)', 7)} AS correct, count(*) AS n FROM pr GROUP BY fold")
def chart_reliability_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Decisiveness against correctness by group: what a trust map shows."""
    hit = ((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double")
    return _predictions(spark, sf).groupBy("fold").agg(r(F.avg(F.abs(F.col("score") - 0.5) * 2), 7).alias("margin"), r(F.avg(hit), 7).alias("correct"), F.count(F.lit(1)).alias("n"))


@query("chart_ood_hist", f"WITH {EMB}, n AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS d FROM e), b AS (SELECT min(d) AS lo, max(d) AS hi FROM n) SELECT least(floor((d - lo) / (hi - lo) * 16), 15)::INT AS bin, count(*) AS n FROM n, b GROUP BY 1")
def chart_ood_hist(spark: SparkSession, sf: str) -> DataFrame:
    """A histogram of distances (here from the origin) in 16 bins."""
    d = load(spark, sf, "embeddings").select(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("d"))
    ends = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    at = F.least(F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 16), F.lit(15)).cast("int")
    return d.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("chart_letter_comparison", f"WITH {SCALE_ROWS} SELECT a.aa AS from_aa, {rhu('avg(abs(b.value - a.value))', 4)} AS mean_change, max(abs(b.value - a.value))::BIGINT AS most FROM lscales a JOIN lscales b ON a.scale_id = b.scale_id AND a.aa <> b.aa GROUP BY a.aa")
def chart_letter_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """How much a change away from each letter moves the scales."""
    i = U.substitution_impact(scales_table(spark, len(SCALES)))
    return i.groupBy("from_aa").agg(r(F.avg("abs_delta"), 4).alias("mean_change"), F.max("abs_delta").alias("most"))


@query("chart_mutation_landscape", f"WITH {SCAN}, g AS (SELECT region, from_aa, to_aa, sum(delta)::BIGINT AS d FROM sn GROUP BY ALL) SELECT region, from_aa, {', '.join(f'coalesce(max(d) FILTER (to_aa = {chr(39)}{a}{chr(39)}), 0) AS {chr(34)}{a}{chr(34)}' for a in LETTERS)} FROM g GROUP BY region, from_aa")
def chart_mutation_landscape(spark: SparkSession, sf: str) -> DataFrame:
    """Letters by letters, in each region: what the changes of all sequences move in sum (in units of 1e-5; 0 on the diagonal)."""
    sums = U.scan_totals(sequences(spark, sf), SCANNED, SCALES)
    return sums.groupBy("region", "from_aa").pivot("to_aa", list(LETTERS)).agg(F.first("delta")).fillna(0)


@query("chart_residue_impact", f"WITH {SCAN} SELECT entry, from_aa, region, {rhu('avg(delta)', 4)} AS mean_delta, max(delta) AS most FROM sn GROUP BY entry, from_aa, region")
def chart_residue_impact(spark: SparkSession, sf: str) -> DataFrame:
    """How much the changes of each letter of a sequence's regions move, on average and at most."""
    sums = U.scan_sums(sequences(spark, sf), SCANNED, SCALES, ("from_aa", "region"))
    return sums.select("entry", "from_aa", "region", r(F.col("delta") / F.col("n"), 4).alias("mean_delta"), "most")


@query("chart_variant_impact", f"WITH {SCAN}, t AS (SELECT entry, pos, from_aa, to_aa, delta, row_number() OVER (PARTITION BY entry ORDER BY delta DESC, pos, to_aa) AS k FROM sn) SELECT entry, concat(from_aa, pos, to_aa) AS variant, delta AS delta_cpp, k::INT AS rank FROM t WHERE k <= 3")
def chart_variant_impact(spark: SparkSession, sf: str) -> DataFrame:
    """The three changes of each entry that move most."""
    best = U.scan_best(sequences(spark, sf), SCANNED, SCALES, 3, "delta")
    return best.select("entry", F.concat("from_aa", F.col("pos").cast("string"), "to_aa").alias("variant"), F.col("delta").alias("delta_cpp"), "rank")


@query("chart_parallel_coordinates", f"WITH x AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part), m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM x) SELECT p_partkey, {rhu('(a - a0) / (a1 - a0)', 8)} AS size, {rhu('(b - b0) / (b1 - b0)', 8)} AS price FROM x, m")
def chart_parallel_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Objectives of all points scaled to 0..1."""
    x = load(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    m = x.agg(*[f(c).alias(f"{c}{k}") for c in "ab" for k, f in enumerate((F.min, F.max))])
    scaled = lambda c: r((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")), 8)
    return x.crossJoin(F.broadcast(m)).select("p_partkey", scaled("a").alias("size"), scaled("b").alias("price"))


@query("chart_mutation_map", f"WITH {SEQ}, v AS (SELECT entry, sequence, substr(sequence, 1, 1) || 'W' || substr(sequence, 3, 2) || 'K' || substr(sequence, 6) AS variant FROM seq WHERE length(sequence) >= 5), d AS (SELECT entry, unnest(range(1, length(sequence) + 1)) AS pos, unnest(string_split(sequence, '')) AS a, unnest(string_split(variant, '')) AS b FROM v) SELECT entry, pos::INT AS pos, a AS from_aa, b AS to_aa FROM d WHERE a <> b")
def chart_mutation_map(spark: SparkSession, sf: str) -> DataFrame:
    """Where variants differ from their wild type."""
    from ..functions.parts import letters_of

    s = sequences(spark, sf).filter(F.length("sequence") >= 5).withColumn("variant", F.concat(F.substring("sequence", 1, 1), F.lit("W"), F.substring("sequence", 3, 2), F.lit("K"), F.expr("substring(sequence, 6)")))
    both = F.arrays_zip(letters_of(F.col("sequence")).alias("a"), letters_of(F.col("variant")).alias("b"))
    return s.select("entry", F.posexplode(both).alias("_p", "_z")).filter("_z.a <> _z.b").select("entry", (F.col("_p") + 1).alias("pos"), F.col("_z.a").alias("from_aa"), F.col("_z.b").alias("to_aa"))


@query("explain_features", f"WITH {SEQ}, long AS (SELECT entry, 'TMD' AS part, substr(sequence, tmd_start, greatest(tmd_stop - tmd_start + 1, 0)) AS s FROM df_seq), {features_sql(_HALVES)}, w(feature, w) AS (VALUES {', '.join(f'({f!r}, {v}::DOUBLE)' for f, v in WEIGHTS.items())}), m AS (SELECT feature, avg(value) AS m FROM feats GROUP BY feature), c AS (SELECT entry, feature, coalesce(value - m, 0) * w AS c FROM feats JOIN w USING (feature) JOIN m USING (feature)) SELECT entry, feature, {rhu('CASE WHEN sum(abs(c)) OVER (PARTITION BY entry) > 0 THEN c / sum(abs(c)) OVER (PARTITION BY entry) * 100 END', 4)} AS feat_impact FROM c")
def explain_features(spark: SparkSession, sf: str) -> DataFrame:
    """Impact of each feature on each sequence's score, by the Shapley values of a linear model."""
    from ..functions.parts import get_parts

    values = X.matrix_values(get_parts(sequences(spark, sf), ("tmd",)), ("tmd",), _HALVES, SCALES)
    c = E.linear_contributions(values.filter(F.col("feature").isin(*WEIGHTS)), WEIGHTS)
    return R.impact(c, "entry").withColumn("feat_impact", r(F.col("feat_impact"), 4))


@query("sample_synthetic_position")
def sample_synthetic_position(spark: SparkSession, sf: str) -> DataFrame:
    """Windows by the letter frequencies of each position of windows at positions, and the same letters scrambled."""
    from ..operators import windows as W

    base = positioned(spark, sf).filter(F.size("pos") > 0).withColumn("center", F.explode("pos")).filter((F.col("center") >= 5) & (F.col("center") <= F.length("sequence") - 4))
    return E.scrambled(E.synthetic_windows(spark, 300, 9, "position", E.position_frequencies(W.cut_windows(base, 9))))


@query("redundancy_clusters")
def redundancy_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items' sequences and the longest one that they are a copy of, greedily by length."""
    from ..functions.alphabet import canonical_sequence

    items = load(spark, sf, "benchmark").select("item_id", canonical_sequence(F.coalesce("text", F.lit(""))).alias("sequence"))
    return E.identity_clusters(items, "item_id", "sequence", 0.8)
