"""Queries over compositions, encodings, labels and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parts as P
from ..functions.alphabet import LETTERS, scales_table
from ..operators import composition as C
from ..operators import embeddings as E
from ..operators import labels as L
from ..operators import select as S
from ..operators.stats import round_half_up
from .catalog import BASE, COUNTS, SCALES, SEQ, load, query, rhu, scales_sql, sequences

LETTER_ROWS = "(VALUES " + ", ".join(f"('{a}')" for a in LETTERS) + ")"
SCALE_ROWS = "lscales(aa, scale_id, value) AS (VALUES " + ", ".join(f"('{a}', '{k}', {v[i]})" for k, v in SCALES.items() for i, a in enumerate(LETTERS)) + ")"


@query("aac", f"WITH {SEQ} SELECT entry, aa, CASE WHEN length(sequence) > 0 THEN {rhu('(len(string_split(sequence, aa)) - 1) / length(sequence)::DOUBLE', 9)} END AS fraction FROM seq, {LETTER_ROWS} v(aa)")
def aac(spark: SparkSession, sf: str) -> DataFrame:
    return C.letter_fractions(sequences(spark, sf), F.col("sequence")).withColumn("fraction", round_half_up(F.col("fraction"), 9))


def _kmer(k: int) -> None:
    sql = f"WITH {BASE}, g AS (SELECT entry, regexp_replace(jmd_n || tmd || jmd_c, '[^{LETTERS}]', '', 'g') AS s FROM parts), w AS (SELECT entry, length(s) - {k - 1} AS m, substr(s, unnest(range(1, length(s) - {k - 2}))::INT, {k}) AS kmer FROM g WHERE length(s) >= {k}) SELECT entry, kmer, count(*) AS n, {rhu('count(*) / m::DOUBLE', 9)} AS fraction FROM w GROUP BY entry, kmer, m"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        parts = P.get_parts(sequences(spark, sf), ("jmd_n", "tmd", "jmd_c"))
        whole = parts.select("entry", C.gap_free(("jmd_n", "tmd", "jmd_c")).alias("s"))
        return C.kmer_fractions(whole, F.col("s"), k).withColumn("fraction", round_half_up(F.col("fraction"), 9))

    query({2: "dpc"}.get(k, f"kmer{k}"), sql)(run)


_kmer(2)
_kmer(3)


@query(
    "kmer_composit_test",
    f"""WITH {SEQ}, lab AS (SELECT doc_id AS entry, quality AS label FROM labels), s AS (SELECT entry, label, sequence FROM seq JOIN lab USING (entry) WHERE length(sequence) >= 2),
    w AS (SELECT entry, label, substr(sequence, unnest(range(1, length(sequence)))::INT, 2) AS kmer FROM s), e AS (SELECT kmer, entry, label FROM w GROUP BY ALL), n AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM s)
    SELECT kmer, count(*) FILTER (label = 1) AS in_test, count(*) FILTER (label = 0) AS in_ref, {rhu("count(*) FILTER (label = 1) / max(n1)::DOUBLE - count(*) FILTER (label = 0) / max(n0)::DOUBLE", 6)} AS share_dif FROM e, n GROUP BY kmer HAVING count(*) >= 5""",
)
def kmer_composit_test(spark: SparkSession, sf: str) -> DataFrame:
    from .catalog import labelled

    s = labelled(spark, sf).filter(F.length("sequence") >= 2).select("entry", "label", "sequence")
    n = s.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    e = C.kmer_counts(s, F.col("sequence"), 2, ("label",))
    counts = e.groupBy("kmer").agg(F.count_if(F.col("label") == 1).alias("in_test"), F.count_if(F.col("label") == 0).alias("in_ref"), F.count(F.lit(1)).alias("_all")).filter("_all >= 5")
    return counts.crossJoin(F.broadcast(n)).select("kmer", "in_test", "in_ref", round_half_up(F.col("in_test") / F.col("n1") - F.col("in_ref") / F.col("n0"), 6).alias("share_dif"))


@query("scale_composition", f"WITH {SEQ}, {scales_sql()}, c AS (SELECT entry, {COUNTS} AS c FROM (SELECT entry, sequence AS x FROM seq)) SELECT entry, scale_id, CASE WHEN list_sum(c) > 0 THEN floor(list_sum(list_transform(list_zip(c, v), lambda p: p[1] * p[2])) / list_sum(c)::DOUBLE + 0.5) / 100000.0::DOUBLE END AS value FROM c, scales")
def scale_composition(spark: SparkSession, sf: str) -> DataFrame:
    return C.scale_composition(sequences(spark, sf), F.col("sequence"), SCALES)


@query(
    "acc_lag",
    f"""WITH {SEQ}, {SCALE_ROWS}, r AS (SELECT entry, i, aa FROM (SELECT entry, unnest(range(1, length(sequence) + 1)) AS i, unnest(string_split(sequence, '')) AS aa FROM seq WHERE length(sequence) > 0)),
    x AS (SELECT entry, scale_id, i, value AS s, lag_ AS lag, lead(value, lag_) OVER (PARTITION BY entry, scale_id, lag_ ORDER BY i) AS nxt FROM r JOIN lscales USING (aa), (VALUES (1), (2)) l(lag_)),
    a AS (SELECT entry, scale_id, lag, count(*) AS n, sum(s)::BIGINT AS t, sum(s::BIGINT * nxt::BIGINT)::BIGINT AS p, sum(s) FILTER (nxt IS NOT NULL)::BIGINT + sum(nxt)::BIGINT AS e FROM x GROUP BY ALL)
    SELECT d.entry, k.scale_id, l.lag::INT AS lag, CASE WHEN n > l.lag THEN {rhu("(p::DOUBLE - t::DOUBLE / n * e::DOUBLE + (n - l.lag)::DOUBLE * (t::DOUBLE / n) * (t::DOUBLE / n)) / (n - l.lag)::DOUBLE / 1e5::DOUBLE / 1e5::DOUBLE", 6)} END AS acc
    FROM seq d CROSS JOIN (SELECT DISTINCT scale_id FROM lscales) k CROSS JOIN (VALUES (1), (2)) l(lag) LEFT JOIN a ON a.entry = d.entry AND a.scale_id = k.scale_id AND a.lag = l.lag""",
)
def acc_lag(spark: SparkSession, sf: str) -> DataFrame:
    return C.auto_covariance(sequences(spark, sf), F.col("sequence"), SCALES, (1, 2))


@query("one_hot", f"WITH {SEQ}, p AS (SELECT unnest(range(1, length(sequence) + 1)) AS pos, unnest(string_split(sequence, '')) AS aa FROM seq WHERE length(sequence) > 0) SELECT pos::INT AS pos, aa, count(*) AS n FROM p GROUP BY pos, aa")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the one-hot matrix that have a one, with how many sequences have it."""
    return C.one_hot(sequences(spark, sf)).groupBy("pos", "aa").agg(F.count(F.lit(1)).alias("n"))


@query("integer_encode", f"WITH {SEQ} SELECT entry, coalesce(array_to_string(list_transform(string_split(sequence, ''), lambda a: instr('{LETTERS}', a)), ','), '') AS codes FROM seq WHERE length(sequence) > 0 UNION ALL SELECT entry, '' FROM seq WHERE length(sequence) = 0")
def integer_encode(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("entry", F.array_join(C.integer_codes(F.col("sequence")).cast("array<string>"), ",").alias("codes"))


@query("pad_parts", f"WITH {BASE} SELECT entry, rpad(sequence, (SELECT max(length(sequence)) FROM parts)::INT, '-') AS sequence FROM parts")
def pad_parts(spark: SparkSession, sf: str) -> DataFrame:
    return C.pad_to_longest(sequences(spark, sf).select("entry", "sequence"), "sequence")


@query("extend_alphabet", f"WITH {SCALE_ROWS} SELECT aa, scale_id, value::DOUBLE AS value FROM lscales UNION ALL SELECT 'X', scale_id, quantile_cont(value::DOUBLE, 0.5) FROM lscales GROUP BY scale_id")
def extend_alphabet(spark: SparkSession, sf: str) -> DataFrame:
    return C.extend_alphabet(scales_table(spark, len(SCALES)), "X", "median")


@query("scale_normalize", f"WITH {SCALE_ROWS} SELECT aa, scale_id, {rhu('(value - min(value) OVER (PARTITION BY scale_id))::DOUBLE / (max(value) OVER (PARTITION BY scale_id) - min(value) OVER (PARTITION BY scale_id))::DOUBLE', 8)} AS value FROM lscales")
def scale_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return C.min_max(scales_table(spark, len(SCALES)), "scale_id", "value").select("aa", "scale_id", round_half_up(F.col("value"), 8).alias("value"))


@query("labels_ovr", "SELECT doc_id, c AS class, (lang = c)::INT AS y FROM documents, (VALUES ('de'), ('en'), ('es'), ('fr')) v(c)")
def labels_ovr(spark: SparkSession, sf: str) -> DataFrame:
    return L.one_vs_rest(load(spark, sf, "documents").select("doc_id", "lang"), "lang", ["de", "en", "es", "fr"]).select("doc_id", "class", "y")


@query("labels_ovo", "SELECT doc_id, a || '|' || b AS pair, (lang = a)::INT AS y FROM documents, (VALUES ('de'), ('en'), ('es'), ('fr')) v(a), (VALUES ('de'), ('en'), ('es'), ('fr')) w(b) WHERE a < b AND (lang = a OR lang = b)")
def labels_ovo(spark: SparkSession, sf: str) -> DataFrame:
    return L.one_vs_one(load(spark, sf, "documents").select("doc_id", "lang"), "lang", ["de", "en", "es", "fr"]).select("doc_id", "pair", "y")


@query("labels_quantile", "SELECT o_orderkey, (o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.5) FROM orders))::INT AS y FROM orders")
def labels_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return L.by_quantile(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.5).select("o_orderkey", "y")


@query("labels_tiered", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.8) AS p, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.3) AS c FROM customer), t AS (SELECT c_custkey, c_acctbal, p, unnest([0.8::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE]) AS tier, unnest([p, b, c]) AS cut FROM customer, q) SELECT c_custkey, tier, CASE WHEN c_acctbal >= p THEN 1 ELSE 0 END AS y FROM t WHERE c_acctbal >= p OR c_acctbal <= cut")
def labels_tiered(spark: SparkSession, sf: str) -> DataFrame:
    return L.by_tiers(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "tier", "y")


@query("labels_pu", "SELECT doc_id, CASE WHEN toxic = 1 THEN 1 ELSE 2 END AS y FROM labels")
def labels_pu(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "labels").select("doc_id", L.positive_unlabelled(F.col("toxic"), 1).alias("y"))


@query("balanced_head", "SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels) WHERE r <= 25")
def balanced_head(spark: SparkSession, sf: str) -> DataFrame:
    return L.balanced_head(load(spark, sf, "labels").select("doc_id", "quality"), "quality", 25, ["doc_id"])


@query("length_filter", f"WITH {SEQ} SELECT entry, length(sequence) AS n FROM seq WHERE length(sequence) BETWEEN 50 AND 2000")
def length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).filter(F.length("sequence").between(50, 2000)).select("entry", F.length("sequence").cast("long").alias("n"))


@query("score_bands", "SELECT p_partkey, (p_size >= 10)::INT + (p_size >= 25)::INT + (p_size >= 40)::INT AS band, CASE WHEN p_size >= 40 THEN 'd' WHEN p_size >= 25 THEN 'c' WHEN p_size >= 10 THEN 'b' ELSE 'a' END AS name FROM part")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return load(spark, sf, "part").select("p_partkey", L.score_band(size, [10, 25, 40]).alias("band"), L.score_group(size, [10, 25, 40], "abcd").alias("name"))


DIMS = 64
EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), el AS (SELECT vec_id, label, unnest(range(0, len(v))) AS dim, unnest(v) AS value FROM e)"


def _long(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", round_half_up(F.col("value"), 6))


@query("embed_minmax", f"WITH {EMB}, f AS (SELECT dim, min(value) AS a, max(value) AS b FROM el GROUP BY dim) SELECT vec_id, dim::INT AS dim, {rhu('CASE WHEN b > a THEN (value - a) / (b - a) ELSE 0 END', 6)} AS value FROM el JOIN f USING (dim)")
def embed_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return _long(E.encode(load(spark, sf, "embeddings"), "embedding", DIMS, "minmax"))


@query("embed_quantile", f"WITH {EMB}, f AS (SELECT dim, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM el GROUP BY dim) SELECT vec_id, dim::INT AS dim, {rhu('CASE WHEN b > a THEN least(greatest((value - a) / (b - a), 0), 1) ELSE 0 END', 6)} AS value FROM el JOIN f USING (dim)")
def embed_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return _long(E.encode(load(spark, sf, "embeddings"), "embedding", DIMS, "quantile"))


@query("embed_sigmoid", f"WITH {EMB}, f AS (SELECT dim, avg(value) AS a, stddev_pop(value) AS b FROM el GROUP BY dim) SELECT vec_id, dim::INT AS dim, {rhu('CASE WHEN b > 0 THEN 1 / (1 + exp(-(value - a) / b)) ELSE 0.5 END', 6)} AS value FROM el JOIN f USING (dim)")
def embed_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return _long(E.encode(load(spark, sf, "embeddings"), "embedding", DIMS, "sigmoid"))


@query("embed_pool", f"WITH {EMB} SELECT label, dim::INT AS dim, {rhu('avg(value)', 6)} AS value FROM el GROUP BY label, dim")
def embed_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = E.pool(load(spark, sf, "embeddings"), "label", "embedding", DIMS)
    return pooled.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", round_half_up(F.col("value"), 6))


@query("pseudo_scales", f"WITH {EMB} SELECT label, dim::INT AS dim, {rhu('avg(value)', 6)} AS mean, {rhu('stddev_pop(value)', 6)} AS std FROM el GROUP BY label, dim")
def pseudo_scales(spark: SparkSession, sf: str) -> DataFrame:
    r = E.pseudo_scales(load(spark, sf, "embeddings"), "label", "embedding")
    return r.select("label", "dim", round_half_up(F.col("mean"), 6).alias("mean"), round_half_up(F.col("std"), 6).alias("std"))


@query("combine_nums", f"WITH {EMB} SELECT vec_id, 2 * len(v) AS dims, {rhu('list_sum(v) * 2', 4)} AS total FROM e")
def combine_nums(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("vec_id", E.as_doubles("embedding").alias("embedding"))
    both = E.combine(e, e.select("vec_id", "embedding"), "vec_id", "embedding")
    return both.select("vec_id", F.size("embedding").cast("long").alias("dims"), round_half_up(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("prune_variance", f"WITH {EMB} SELECT dim::INT AS dim, {rhu('var_pop(value)', 6)} AS variance FROM el GROUP BY dim HAVING var_pop(value) > 0.01")
def prune_variance(spark: SparkSession, sf: str) -> DataFrame:
    v = E.long_vectors(load(spark, sf, "embeddings"), "vec_id")
    return S.prune_by_variance(v, "dim", "value", 0.01).withColumn("variance", round_half_up(F.col("variance"), 6))


@query("column_correlations", f"WITH {EMB}, s AS (SELECT vec_id, dim, value FROM el) SELECT a.dim::INT AS i, b.dim::INT AS j, {rhu('corr(a.value, b.value)', 4)} AS cor FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY 1, 2")
def column_correlations(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.column_correlations(load(spark, sf, "embeddings").select("embedding"), "embedding", DIMS)
    return pairs.withColumn("cor", round_half_up(F.col("cor"), 4))


@query("prune_correlation")
def prune_correlation(spark: SparkSession, sf: str) -> DataFrame:
    kept = S.greedy_correlation(S.column_correlations(load(spark, sf, "embeddings").select("embedding"), "embedding", DIMS), DIMS, 0.05)
    return spark.createDataFrame([(k,) for k in kept], "dim int")
