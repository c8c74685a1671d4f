"""Queries over metrics, clusters, positive-unlabelled sets, reliability, intervals and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import windows as W
from ..operators.stats import round_half_up as r
from ..sources import annotations as A
from ..sources import fasta
from .catalog import SEQ, load, query, rhu, sequences
from .encoding import DIMS, EMB


@query(
    "smooth_scores",
    f"""WITH ev AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events), x AS (SELECT event_id, user_id, value, lag(value, 2) OVER w AS a, lag(value, 1) OVER w AS b, lead(value, 1) OVER w AS c, lead(value, 2) OVER w AS d FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, {rhu("greatest(value, (coalesce(a, 0) + coalesce(2 * b, 0) + coalesce(3 * value, 0) + coalesce(2 * c, 0) + coalesce(d, 0)) / nullif((a IS NOT NULL)::INT + 2 * (b IS NOT NULL)::INT + 3 * (value IS NOT NULL)::INT + 2 * (c IS NOT NULL)::INT + (d IS NOT NULL)::INT, 0)::DOUBLE)", 6)} AS smooth FROM x""",
)
def smooth_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh score is taken for missing and filled from its neighbours."""
    e = load(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return M.smooth(e, "user_id", ["ts", "event_id"], "value").select("event_id", r(F.col("smooth"), 6).alias("smooth"))


_SCORED = "s AS (SELECT e.vec_id, v[1] + v[2] AS score, (label < 3)::INT AS truth, label FROM e)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    x = load(spark, sf, "embeddings")
    return x.select("vec_id", (F.col("embedding")[0].cast("double") + F.col("embedding")[1].cast("double")).alias("score"), (F.col("label") < 3).cast("int").alias("truth"), "label")


@query("detection_metrics", f"WITH {EMB}, {_SCORED}, c AS (SELECT count(*) FILTER (score >= 0 AND truth = 1) AS tp, count(*) FILTER (score >= 0 AND truth = 0) AS fp, count(*) FILTER (score < 0 AND truth = 1) AS fn, count(*) FILTER (score < 0 AND truth = 0) AS tn FROM s) SELECT tp, fp, fn, tn, {rhu('tp / (tp + fn)::DOUBLE', 6)} AS recall, {rhu('tp / (tp + fp)::DOUBLE', 6)} AS precision, {rhu('2 * tp / (2 * tp + fp + fn)::DOUBLE', 6)} AS f1, {rhu('(tp * tn - fp * fn)::DOUBLE / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))', 6)} AS mcc FROM c")
def detection_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = M.detection(_scored(spark, sf), "score", "truth", 0.0)
    return d.select("tp", "fp", "fn", "tn", *[r(F.col(c), 6).alias(c) for c in ("recall", "precision", "f1", "mcc")])


@query("average_precision", f"WITH {EMB}, {_SCORED}, g AS (SELECT vec_id, vec_id % 10 AS grp, score, truth FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, vec_id) AS n, sum(truth) OVER (PARTITION BY grp ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING) AS t FROM g) SELECT grp, {rhu('sum(t / n::DOUBLE) FILTER (truth = 1) / sum(truth)', 6)} AS ap FROM o GROUP BY grp")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).withColumn("grp", F.col("vec_id") % 10)
    return M.average_precision(rows, "grp", "score", "truth", ["vec_id"]).select("grp", r(F.col("ap"), 6).alias("ap"))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return M.bootstrap_ci(load(spark, sf, "events"), "event_type", "value", "event_id")


_CENTERS = f"{EMB}, ct AS (SELECT label, dim, {rhu('avg(value)', 3)} AS c FROM el GROUP BY label, dim), dd AS (SELECT el.vec_id, el.label, sum((value - c) * (value - c)) AS d2 FROM el JOIN ct USING (label, dim) GROUP BY el.vec_id, el.label)"


@query("centers", f"WITH {_CENTERS} SELECT label, dim::INT AS dim, c AS center FROM ct")
def centers(spark: SparkSession, sf: str) -> DataFrame:
    c = M.centers(load(spark, sf, "embeddings"), "label", "embedding", DIMS)
    return c.select("label", F.posexplode("center").alias("dim", "center"))


@query("bic_score", f"WITH {_CENTERS}, p AS (SELECT label, count(*)::DOUBLE AS n, sum(d2) AS ss FROM dd GROUP BY label), a AS (SELECT sum(n) AS n, count(*)::DOUBLE AS m, sum(ss) AS ss, sum(n * ln(n)) AS x FROM p) SELECT {rhu('x - n * ln(n) - n * 64 / 2.0::DOUBLE * ln(2 * 3.141592653589793::DOUBLE * (ss / (n - m) / 64)) - (n - m) * 64 / 2.0::DOUBLE - 0.5::DOUBLE * m * ln(n) * 65', 2)} AS bic FROM a")
def bic_score(spark: SparkSession, sf: str) -> DataFrame:
    return M.bic(load(spark, sf, "embeddings"), "label", "embedding", DIMS).select(r(F.col("bic"), 2).alias("bic"))


_MEDOIDS = f"{EMB}, mt AS (SELECT label, dim, avg(value) AS c FROM el GROUP BY label, dim), cr AS (SELECT el.vec_id, el.label, corr(value, c) AS k FROM el JOIN mt USING (label, dim) GROUP BY el.vec_id, el.label), md AS (SELECT label, vec_id AS medoid, k FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k DESC, vec_id) AS n FROM cr) WHERE n = 1)"


@query("medoids", f"WITH {_MEDOIDS} SELECT label, medoid, {rhu('k', 6)} AS closeness FROM md")
def medoids(spark: SparkSession, sf: str) -> DataFrame:
    return M.medoids(load(spark, sf, "embeddings"), "label", "vec_id", "embedding", DIMS).withColumn("closeness", r(F.col("closeness"), 6))


@query("dist_to_center", f"WITH {_MEDOIDS} SELECT e.vec_id, e.label, CASE WHEN e.vec_id = medoid THEN 0 ELSE {rhu('1 - corr(e.value, m.value)', 6)} END AS distance FROM el e JOIN md ON md.label = e.label JOIN el m ON m.vec_id = medoid AND m.dim = e.dim GROUP BY e.vec_id, e.label, medoid")
def dist_to_center(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each vector to the medoid of its cluster."""
    return M.distance_to_medoid(load(spark, sf, "embeddings"), "label", "vec_id", "embedding", DIMS).withColumn("distance", r(F.col("distance"), 6))


@query("medoids_euclidean", f"WITH {EMB}, mt AS (SELECT label, dim, avg(value) AS c FROM el GROUP BY label, dim), cr AS (SELECT el.vec_id, el.label, sqrt(sum((value - c) * (value - c))) AS k FROM el JOIN mt USING (label, dim) GROUP BY el.vec_id, el.label) SELECT label, vec_id AS medoid, {rhu('k', 6)} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, vec_id) AS n FROM cr) WHERE n = 1")
def medoids_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    d = M.medoids(load(spark, sf, "embeddings"), "label", "vec_id", "embedding", DIMS, "euclidean")
    return d.select("label", "medoid", r(-F.col("closeness"), 6).alias("distance"))


@query("coverage", f"SELECT lang, {rhu('count(DISTINCT source) * 100.0::DOUBLE / (SELECT count(DISTINCT source) FROM documents)', 4)} AS coverage FROM documents GROUP BY lang")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("lang", "source")
    return M.coverage(d, "lang", "source", d).withColumn("coverage", r(F.col("coverage"), 4))


@query("name_clusters", "SELECT lang, source AS name, n FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY lang, source) WHERE r = 1")
def name_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return M.name_groups(load(spark, sf, "documents").select("lang", "source"), "lang", "source")


@query("pu_distance", f"WITH {EMB}, d AS (SELECT u.vec_id, avg(list_distance(u.v, p.v)) AS m FROM e u, e p WHERE u.label <> 0 AND p.label = 0 GROUP BY u.vec_id) SELECT vec_id, {rhu('m', 4)} AS euclidean_dif FROM d ORDER BY m DESC, vec_id LIMIT 50")
def pu_distance(spark: SparkSession, sf: str) -> DataFrame:
    x = load(spark, sf, "embeddings")
    d = M.mean_distance_to(x.filter("label <> 0"), x.filter("label = 0"), "vec_id", "embedding")
    return M.reliable_negatives(d, "vec_id", 50).select("vec_id", r(F.col("distance"), 4).alias("euclidean_dif"))


@query("pu_distance_metrics", f"WITH {EMB}, d AS (SELECT u.vec_id, avg(1 - list_cosine_similarity(u.v, p.v)) AS c, avg(list_sum(list_transform(list_zip(u.v, p.v), lambda z: abs(z[1] - z[2])))) AS m FROM e u, e p WHERE u.label <> 0 AND p.label = 0 GROUP BY u.vec_id) SELECT vec_id, {rhu('c', 4)} AS cosine_dif, {rhu('m', 4)} AS manhattan_dif FROM d")
def pu_distance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distances to the positives by the other metrics, of all unlabelled vectors."""
    x = load(spark, sf, "embeddings")
    c, m = (M.mean_distance_to(x.filter("label <> 0"), x.filter("label = 0"), "vec_id", "embedding", k) for k in ("cosine", "manhattan"))
    return c.join(m.withColumnRenamed("distance", "_m"), "vec_id").select("vec_id", r(F.col("distance"), 4).alias("cosine_dif"), r(F.col("_m"), 4).alias("manhattan_dif"))


@query("pu_eval", f"WITH {EMB} SELECT label, {rhu('avg(s)', 6)} AS avg_std, {rhu('avg(q)', 6)} AS avg_iqr FROM (SELECT label, dim, stddev_pop(value) AS s, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q FROM el GROUP BY label, dim) GROUP BY label")
def pu_eval(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings").select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("dim", "value"))
    per = v.groupBy("label", "dim").agg(F.stddev_pop("value").alias("s"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("q"))
    return per.groupBy("label").agg(r(F.avg("s"), 6).alias("avg_std"), r(F.avg("q"), 6).alias("avg_iqr"))


@query("pu_compare_sets", "SELECT a, b, c, count(*) AS n FROM (SELECT (p_size > 25)::INT AS a, (p_retailprice > 1500)::INT AS b, (p_partkey % 3 = 0)::INT AS c FROM part) GROUP BY a, b, c")
def pu_compare_sets(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select((F.col("p_size") > 25).cast("int").alias("a"), (F.col("p_retailprice") > 1500).cast("int").alias("b"), (F.col("p_partkey") % 3 == 0).cast("int").alias("c"))
    return p.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


_P = "pr AS (SELECT o_orderkey, ((o_orderkey * 7919) % 10007) / 10007.0::DOUBLE AS p, (o_orderstatus = 'F')::INT AS y FROM orders)"


def _probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select("o_orderkey", (F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)) / 10007.0).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query("sharpness", f"WITH {_P} SELECT o_orderkey, {rhu('abs(p - 0.5::DOUBLE) * 2', 6)} AS margin, {rhu('CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN p < 1 THEN -(1 - p) * log2(1 - p) ELSE 0 END', 6)} AS entropy FROM pr")
def sharpness(spark: SparkSession, sf: str) -> DataFrame:
    margin, entropy = M.sharpness(F.col("p"))
    return _probabilities(spark, sf).select("o_orderkey", r(margin, 6).alias("margin"), r(entropy, 6).alias("entropy"))


@query("calibration_bins", f"WITH {_P} SELECT least(floor(p * 5), 4)::INT AS bin, count(*) AS n, {rhu('avg(p)', 6)} AS mean_p, {rhu('avg(y)', 6)} AS rate FROM pr GROUP BY 1")
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    b = M.calibration_bins(_probabilities(spark, sf), "p", "y")
    return b.select("bin", "n", r(F.col("mean_p"), 6).alias("mean_p"), r(F.col("rate"), 6).alias("rate"))


@query("conformal_sets", f"WITH {_P}, sc AS (SELECT CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM pr WHERE o_orderkey % 3 = 0), o AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM sc), t AS (SELECT min(s) AS t FROM o WHERE i >= ceil((n - 1) * least(1, ceil((n + 1) * 0.9::DOUBLE) / n::DOUBLE)) + 1) SELECT CASE WHEN 1 - p <= t AND p <= t THEN 'both' WHEN 1 - p <= t THEN 'pos' WHEN p <= t THEN 'neg' ELSE 'none' END AS s, count(*) AS n FROM pr, t WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def conformal_sets(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the orders calibrates (the operator's split), the others get their sets."""
    rows = _probabilities(spark, sf)
    scores = rows.filter("o_orderkey % 3 = 0").select(F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p")).alias("s"))
    rest = rows.filter("o_orderkey % 3 <> 0").crossJoin(F.broadcast(M.conformal_quantile(scores, "s", 0.1)))
    return rest.groupBy(M.conformal_sets(F.col("p"), F.col("threshold")).alias("s")).agg(F.count(F.lit(1)).alias("n"))


@query("uncertainty", f"WITH e AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id) SELECT user_id, {rhu('least(greatest(m / 100 - 1.645::DOUBLE * s / 100, 0), 1)', 6)} AS low, {rhu('least(greatest(m / 100 + 1.645::DOUBLE * s / 100, 0), 1)', 6)} AS high FROM e")
def uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("m"), (F.stddev_pop("value") / 100).alias("s"))
    low, high = M.uncertainty(F.col("m"), F.col("s"))
    return e.select("user_id", r(low, 6).alias("low"), r(high, 6).alias("high"))


@query("fold_scores_compare", f"WITH f AS (SELECT l_orderkey % 5 AS fold, l_shipmode_ AS model, avg(l_quantity) AS score FROM (SELECT l_orderkey, l_quantity, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1, 2) SELECT a.model AS model_a, b.model AS model_b, {rhu('avg(a.score - b.score)', 5)} AS delta, count(*) FILTER (a.score > b.score) AS wins FROM f a JOIN f b USING (fold) WHERE a.model < b.model GROUP BY 1, 2")
def fold_scores_compare(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("fold"), F.col("l_returnflag").alias("model")).agg(F.avg("l_quantity").alias("score"))
    return M.paired_deltas(f, "fold", "model", "score").withColumn("delta", r(F.col("delta"), 5))


@query("interval_expand", "SELECT pos, count(*) AS n FROM (SELECT unnest(range(o_orderkey % 50 + 1, o_orderkey % 50 + o_custkey % 7 + 1)) AS pos FROM orders) GROUP BY pos")
def interval_expand(spark: SparkSession, sf: str) -> DataFrame:
    iv = load(spark, sf, "orders").select((F.col("o_orderkey") % 50 + 1).alias("start"), (F.col("o_orderkey") % 50 + F.col("o_custkey") % 7).alias("stop"))
    return M.expand_intervals(iv).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


@query("annotation_ingest", "SELECT p_partkey::VARCHAR AS protein_id, p_brand AS feature_type, p_size AS start, p_size AS \"end\", 'user' AS source, 1.0::DOUBLE AS score FROM part")
def annotation_ingest(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("protein_id"), F.col("p_brand").alias("feature_type"), F.col("p_size").alias("start"))
    return A.ingest(p)


@query("json_props", "SELECT k, count(*) AS n FROM (SELECT (props->>'k')::INT AS k FROM events) GROUP BY k")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "chopping_parse",
    """WITH t AS (SELECT p_partkey, concat(p_partkey % 5 + 1, '-', p_size + 5, CASE WHEN p_size % 2 = 0 THEN concat('_', p_size + 7, '-', p_size + 9) ELSE '' END, ',', p_size + 20, '-', p_size + 20 + p_partkey % 30) AS c FROM part),
    d AS (SELECT p_partkey, unnest(string_split(c, ',')) AS dom, unnest(range(1, len(string_split(c, ',')) + 1)) AS domain FROM t),
    x AS (SELECT p_partkey, domain, unnest(string_split(dom, '_')) AS seg FROM d)
    SELECT p_partkey, domain::INT AS domain, split_part(seg, '-', 1)::INT AS start, split_part(seg, '-', 2)::INT AS stop FROM x""",
)
def chopping_parse(spark: SparkSession, sf: str) -> DataFrame:
    """A row per segment of each domain of texts like ``1-10_12-14,25-40``."""
    size, key, text = F.col("p_size"), F.col("p_partkey"), lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    s = lambda c: c.cast("string")
    second = F.when(size % 2 == 0, text("_", s(size + 7), "-", s(size + 9))).otherwise("")
    chopped = load(spark, sf, "part").select("p_partkey", A.chopping(text(s(key % 5 + 1), "-", s(size + 5), second, ",", s(size + 20), "-", s(size + 20 + key % 30))).alias("c"))
    domains = chopped.select("p_partkey", F.posexplode("c").alias("_d", "segments"))
    return domains.select("p_partkey", (F.col("_d") + 1).alias("domain"), F.explode("segments").alias("_s")).select("p_partkey", "domain", "_s.start", "_s.stop")


@query("pae_bands", f"WITH m AS (SELECT l_suppkey AS i, l_partkey % 40 AS j, l_quantity AS v FROM lineitem) SELECT i, CASE WHEN abs(i - j) <= 5 THEN 'near' WHEN abs(i - j) <= 15 THEN 'middle' ELSE 'far' END AS band, {rhu('avg(v)', 5)} AS mean, count(*) AS n FROM m GROUP BY 1, 2")
def pae_bands(spark: SparkSession, sf: str) -> DataFrame:
    m = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 40).alias("j"), F.col("l_quantity").alias("v"))
    return M.pair_bands(m, "i", "j", "v").withColumn("mean", r(F.col("mean"), 5))


@query("contact_count", f"WITH {EMB}, x AS (SELECT vec_id, v[1] AS x, v[2] AS y, v[3] AS z FROM e) SELECT a.vec_id, count(b.vec_id) AS contacts FROM x a LEFT JOIN x b ON a.vec_id <> b.vec_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0025::DOUBLE GROUP BY a.vec_id")
def contact_count(spark: SparkSession, sf: str) -> DataFrame:
    x = load(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return M.contacts(x, "vec_id", ["x", "y", "z"], 0.05)


@query("fasta_lines", f"WITH {SEQ} SELECT '>' || entry || '|' || lang || chr(10) || sequence AS value FROM seq")
def fasta_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fasta.fasta_lines(sequences(spark, sf), infos=("lang",))


@query("annotation_context", f"WITH {SEQ}, c AS (SELECT entry, unnest(range(5, length(sequence) - 3)) AS pos FROM seq) SELECT entry, pos::INT AS pos FROM c WHERE pos BETWEEN entry % 11 + 1 AND entry % 11 + 30 AND NOT pos BETWEEN entry % 7 + 20 AND entry % 7 + 45")
def annotation_context(spark: SparkSession, sf: str) -> DataFrame:
    """Centres of windows inside one kind of annotated interval and outside another: each position carries its tags, no row the whole sequence."""
    n, key = F.length("sequence"), F.col("entry")
    inside = lambda i, m, a, b: i.between(key % m + a, key % m + b)
    tag = lambda i: F.struct(i.alias("pos"), F.when(inside(i, 11, 1, 30), "helix").otherwise("none").alias("helix"), F.when(inside(i, 7, 20, 45), "site").otherwise("none").alias("site"))
    rows = sequences(spark, sf).filter(n >= 9).select("entry", F.explode(F.transform(F.sequence(F.lit(5), n - 4), tag)).alias("_t"))
    rows = rows.select("entry", "_t.pos", F.array("_t.helix").alias("helix"), F.array("_t.site").alias("site"), F.lit(1).alias("center"))
    return W.context_filter(W.context_filter(rows, "helix", inside=["helix"]), "site", outside=["site"]).select("entry", "pos")
