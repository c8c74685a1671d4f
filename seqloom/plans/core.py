"""Queries over parts, splits, features and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parts as P
from ..functions.alphabet import LETTERS, replace_non_canonical, scale_metadata, scale_values
from ..functions.splits import feature_id, patterns, periodic_patterns, segments, split_feature_id
from ..operators import features as X
from ..operators import matrix as M
from ..operators import select as S
from ..operators import stats as T
from .catalog import BASE, PARTS, PATTERNS, PERIODIC, SCALES, SEGMENTS, SEQ, features_sql, labelled, load, query, rhu, sequences, splits_sql


@query("parts_basic", f"WITH {BASE} SELECT entry, tmd, jmd_n, jmd_c FROM parts")
def parts_basic(spark: SparkSession, sf: str) -> DataFrame:
    return P.get_parts(sequences(spark, sf), ("tmd", "jmd_n", "jmd_c"))


@query(
    "parts_all13",
    f"""WITH {BASE} SELECT entry, tmd, tmd AS tmd_e, tmd_n, tmd_c, jmd_n, jmd_c, '' AS ext_c, '' AS ext_n, tmd_jmd, jmd_n_tmd_n, tmd_c_jmd_c, tmd_n AS ext_n_tmd_n, tmd_c AS tmd_c_ext_c FROM parts""",
)
def parts_all13(spark: SparkSession, sf: str) -> DataFrame:
    return P.get_parts(sequences(spark, sf), P.ALL_PARTS)


@query(
    "parts_from_ends",
    f"WITH {SEQ} SELECT entry, substr(sequence, 11, greatest(length(sequence) - 20, 0)) AS tmd, rpad(substr(sequence, greatest(length(sequence) - 9, 1), 10), 10, '-') AS jmd_c FROM seq WHERE length(sequence) >= 20",
)
def parts_from_ends(spark: SparkSession, sf: str) -> DataFrame:
    seq = sequences(spark, sf).filter(F.length("sequence") >= 20).select("entry", "sequence")
    return P.get_parts(seq, ("tmd", "jmd_c"))


@query(
    "parts_anchor",
    f"""WITH {SEQ}, a AS (SELECT entry, sequence, unnest([length(sequence) // 3, length(sequence) // 2, length(sequence) - 2]) AS p FROM seq)
    SELECT entry, concat(entry, '_', p - 4, '-', p + 4) AS entry_win, (p - 4)::BIGINT AS start, (p + 4)::BIGINT AS stop, substr(sequence, p - 4, 9) AS "window" FROM a WHERE p - 4 >= 1 AND p + 4 <= length(sequence)""",
)
def parts_anchor(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("sequence")
    seq = sequences(spark, sf).select("entry", "sequence", F.array(F.floor(n / 3), F.floor(n / 2), (n - 2).cast("long")).alias("pos"))
    out = P.explode_anchors(seq, "pos", 9)
    return out.select("entry", "entry_win", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "window")


@query("gap_filter", f"WITH {BASE} SELECT entry, jmd_n, jmd_c FROM parts WHERE NOT contains(jmd_n, '-') AND NOT contains(jmd_c, '-')")
def gap_filter(spark: SparkSession, sf: str) -> DataFrame:
    return P.get_parts(sequences(spark, sf), ("jmd_n", "jmd_c"), drop_gaps=True)


@query(
    "canonical_replace",
    f"SELECT doc_id AS entry, regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[^{LETTERS}]', '-', 'g') AS sequence FROM documents",
)
def canonical_replace(spark: SparkSession, sf: str) -> DataFrame:
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return load(spark, sf, "documents").select(F.col("doc_id").alias("entry"), replace_non_canonical(letters).alias("sequence"))


@query(
    "non_canonical_remove",
    f"WITH u AS (SELECT doc_id AS entry, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents) SELECT entry, length(s) AS n FROM u WHERE NOT regexp_matches(s, '[^{LETTERS}]')",
)
def non_canonical_remove(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.alphabet import is_canonical

    u = load(spark, sf, "documents").select(F.col("doc_id").alias("entry"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("s"))
    return u.filter(is_canonical(F.col("s"))).select("entry", F.length("s").cast("long").alias("n"))


def _split_query(name: str, splits: list) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        parts = P.get_parts(sequences(spark, sf), PARTS)
        return X.split_letters(parts, PARTS, splits)

    query(name, f"WITH {BASE}, {splits_sql(splits)} SELECT entry, part, split, x AS letters FROM letters")(run)


_split_query("split_segment", SEGMENTS)
_split_query("split_pattern", PATTERNS)
_split_query("split_periodic", PERIODIC)


@query("feature_matrix_long", f"WITH {BASE}, {features_sql()} SELECT entry, feature, part, split, scale_id, value FROM feats")
def feature_matrix_long(spark: SparkSession, sf: str) -> DataFrame:
    return M.matrix_values(P.get_parts(sequences(spark, sf), PARTS), PARTS, SEGMENTS, SCALES).select("entry", "feature", "part", "split", "scale_id", "value")


@query("feature_matrix_pattern", f"WITH {BASE}, {features_sql(PATTERNS + PERIODIC)} SELECT entry, feature, value FROM feats")
def feature_matrix_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return M.matrix_values(P.get_parts(sequences(spark, sf), PARTS), PARTS, PATTERNS + PERIODIC, SCALES).select("entry", "feature", "value")


def values(spark: SparkSession, sf: str, splits: list = SEGMENTS) -> DataFrame:
    parts = P.get_parts(labelled(spark, sf), PARTS, keep=("entry", "label"))
    return M.matrix_values(parts, PARTS, splits, SCALES, ("entry", "label"))


VALUES = f"{BASE}, {features_sql()}, lab AS (SELECT doc_id AS entry, quality AS label FROM labels), val AS (SELECT feats.*, label FROM feats JOIN lab USING (entry))"
MOMENTS = f"""mom AS (
  SELECT feature, count(value) FILTER (label = 1) AS n_test, count(value) FILTER (label = 0) AS n_ref,
    coalesce(sum(round(value * 100000)::BIGINT) FILTER (label = 1), 0) AS s1, coalesce(sum(round(value * 100000)::BIGINT) FILTER (label = 0), 0) AS s0,
    coalesce(sum(round(value * 100000)::BIGINT * round(value * 100000)::BIGINT) FILTER (label = 1), 0) AS q1, coalesce(sum(round(value * 100000)::BIGINT * round(value * 100000)::BIGINT) FILTER (label = 0), 0) AS q0
  FROM val GROUP BY feature
), fin AS (
  SELECT *, {rhu("s1::DOUBLE / n_test / 1e5::DOUBLE - s0::DOUBLE / n_ref / 1e5::DOUBLE", 6)} AS mean_dif, {rhu("abs(s1::DOUBLE / n_test / 1e5::DOUBLE - s0::DOUBLE / n_ref / 1e5::DOUBLE)", 6)} AS abs_mean_dif,
    {rhu("sqrt(greatest((q1::DOUBLE / n_test - pow(s1::DOUBLE / n_test, 2)) / 1e10::DOUBLE, 0))", 6)} AS std_test, {rhu("sqrt(greatest((q0::DOUBLE / n_ref - pow(s0::DOUBLE / n_ref, 2)) / 1e10::DOUBLE, 0))", 6)} AS std_ref
  FROM mom
)"""
RANKS = f"""dist AS (SELECT feature, value, count(*) AS n, count(*) FILTER (label = 1) AS t FROM val WHERE value IS NOT NULL GROUP BY feature, value),
rk AS (SELECT feature, n, t, (coalesce(sum(n) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 + n + 1) * t AS r FROM dist),
sums AS (SELECT feature, sum(r)::BIGINT AS rank_sum2, sum(t)::BIGINT AS n1, (sum(n) - sum(t))::BIGINT AS n0 FROM rk GROUP BY feature),
auc AS (SELECT *, {rhu("abs((rank_sum2 - n1 * (n1 + 1)) / (n1 * n0 * 2.0::DOUBLE) - 0.5::DOUBLE)", 3)} AS abs_auc, {rhu("(rank_sum2 - n1 * (n1 + 1)) / (n1 * n0 * 2.0::DOUBLE) - 0.5::DOUBLE", 3)} AS auc FROM sums)"""
STATS = "SELECT feature, abs_auc, mean_dif, abs_mean_dif, std_test, std_ref, n_test, n_ref FROM fin JOIN auc USING (feature)"


def erfc_sql(x: str) -> str:
    """The complementary error function of an expression: the same sum, whose state and coefficients are lists of two."""
    y = "(8.0::DOUBLE / (2.0::DOUBLE + ex) - 2.0::DOUBLE)"
    terms = "[" + ", ".join(["[0.0, 0.0]", *(f"[{c!r}, 0.0]" for c in T.ERFC[:0:-1])]) + "]::DOUBLE[][]"
    sums = f"list_reduce({terms}, lambda s, c: [{y} * s[1] - s[2] + c[1], s[1]])"
    return f"{x} AS ex, {sums} AS es, 2.0::DOUBLE / (2.0::DOUBLE + ex) * exp((({T.ERFC[0]!r})::DOUBLE + {y} * es[1]) * 0.5::DOUBLE - es[2] - ex * ex) AS erfc"


PVALUES = f"""pv0 AS (SELECT feature, (least((rank_sum2 - n1 * (n1 + 1)) / 2.0::DOUBLE, n1 * n0 - (rank_sum2 - n1 * (n1 + 1)) / 2.0::DOUBLE) - n1 * n0 / 2.0::DOUBLE) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0::DOUBLE) AS z FROM sums),
pv AS (SELECT feature, {erfc_sql("abs(z) / sqrt(2.0::DOUBLE)")} FROM pv0),
fdr0 AS (SELECT feature, erfc AS p, erfc * count(*) OVER () / count(*) OVER (ORDER BY erfc RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM pv),
fdr AS (SELECT feature, p, least(min(raw) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0::DOUBLE) AS q FROM fdr0)"""


def _p_rounded(df: DataFrame) -> DataFrame:
    """Twelve digits for the comparison with SQL; the operator gives all."""
    return df.withColumns({c: T.round_half_up(F.col(c), 12) for c in df.columns if c.startswith("p_val")})


@query("feature_stats", f"WITH {VALUES}, {MOMENTS}, {RANKS}, {PVALUES} SELECT feature, abs_auc, abs_mean_dif, mean_dif, std_test, std_ref, {rhu('p', 12)} AS p_val_mann_whitney, {rhu('q', 12)} AS p_val_fdr_bh, n_test, n_ref FROM fin JOIN auc USING (feature) JOIN fdr USING (feature)")
def feature_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: all features of all labelled documents, compared between the labels."""
    return _p_rounded(T.feature_stats(values(spark, sf)))


@query("feature_stats_parametric")
def feature_stats_parametric(spark: SparkSession, sf: str) -> DataFrame:
    """The same with Student's t-test."""
    return T.feature_stats(values(spark, sf), parametric=True)


TIED = f"""tie AS (SELECT feature, sum(n::DOUBLE * n * n - n) AS ties FROM dist GROUP BY feature),
tz AS (SELECT feature, (rank_sum2 - n1 * (n1 + 1)) / 2.0::DOUBLE AS u1, n1, n0, sqrt(n1 * n0 / 12.0::DOUBLE * (n1 + n0 + 1 - ties / ((n1 + n0)::DOUBLE * (n1 + n0 - 1)))) AS sd FROM sums JOIN tie USING (feature)),
te AS (SELECT feature, u1, {erfc_sql("greatest((greatest(u1, n1 * n0 - u1) - n1 * n0 / 2.0::DOUBLE - 0.5::DOUBLE) / sd, 0) / sqrt(2.0::DOUBLE)")} FROM tz)"""


@query("mwu_tie_corrected", f"WITH {VALUES}, {RANKS}, {TIED} SELECT feature, u1, {rhu('least(erfc, 1)', 10)} AS p_value FROM te")
def mwu_tie_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return T.mann_whitney_exact_ties(T.value_counts(values(spark, sf))).withColumn("p_value", T.round_half_up(F.col("p_value"), 10))


@query("partial_moments", f"WITH {VALUES}, {MOMENTS} SELECT feature, n_test, n_ref, s1::BIGINT AS sum_test, s0::BIGINT AS sum_ref, q1::BIGINT AS sq_test, q0::BIGINT AS sq_ref FROM mom")
def partial_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of samples first, then their sums: equal to the sums at once."""
    batches = values(spark, sf).withColumn("_batch", F.pmod("entry", F.lit(4)))
    part = T.group_moments(batches.withColumn("_key", F.struct("feature", "_batch")), key="_key")
    sums = ("n_test", "n_ref", "sum_test", "sum_ref", "sq_test", "sq_ref")
    return part.groupBy(F.col("_key.feature").alias("feature")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


@query("prefilter_topk", f"WITH {VALUES}, {MOMENTS}, {RANKS} SELECT feature, abs_mean_dif, std_test FROM fin WHERE std_test <= 0.2 ORDER BY abs_mean_dif DESC, std_test, feature LIMIT 20")
def prefilter_topk(spark: SparkSession, sf: str) -> DataFrame:
    return S.prefilter(T.finalize_moments(T.group_moments(values(spark, sf))), 0.2, 20).select("feature", "abs_mean_dif", "std_test")


@query("auc_adjusted", f"WITH {VALUES}, {RANKS} SELECT feature, auc, abs_auc, n1, n0 FROM auc")
def auc_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return T.adjusted_auc(T.rank_sums(values(spark, sf))).select("feature", "auc", "abs_auc", "n1", "n0")


MWU = f"mw AS (SELECT *, least((rank_sum2 - n1 * (n1 + 1)) / 2.0::DOUBLE, n1 * n0 - (rank_sum2 - n1 * (n1 + 1)) / 2.0::DOUBLE) AS u FROM sums), mz AS (SELECT *, {rhu('(u - n1 * n0 / 2.0::DOUBLE) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0::DOUBLE)', 6)} AS z FROM mw)"


@query("mwu_u_z", f"WITH {VALUES}, {RANKS}, {MWU} SELECT feature, u, z FROM mz")
def mwu_u_z(spark: SparkSession, sf: str) -> DataFrame:
    return T.mann_whitney(T.rank_sums(values(spark, sf))).select("feature", "u", "z")


@query("mwu_pvalue", f"WITH {VALUES}, {RANKS}, {PVALUES} SELECT feature, {rhu('z', 6)} AS z, {rhu('p', 12)} AS p_value, {rhu('q', 12)} AS p_fdr FROM fdr JOIN pv0 USING (feature)")
def mwu_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    tested = T.mann_whitney(T.rank_sums(values(spark, sf)), digits=None).withColumn("p_value", T.two_sided_p("z"))
    return T.benjamini_hochberg(tested).select("feature", *[T.round_half_up(F.col(c), d).alias(c) for c, d in (("z", 6), ("p_value", 12), ("p_fdr", 12))])


@query(
    "t_statistic",
    f"""WITH {VALUES}, {MOMENTS}, p AS (SELECT *, ((q1::DOUBLE - pow(s1::DOUBLE, 2) / n_test) + (q0::DOUBLE - pow(s0::DOUBLE, 2) / n_ref)) / (n_test::DOUBLE + n_ref::DOUBLE - 2) AS v FROM mom)
    SELECT feature, CASE WHEN v > 0 THEN {rhu("(s1::DOUBLE / n_test - s0::DOUBLE / n_ref) / sqrt(v * (1 / n_test::DOUBLE + 1 / n_ref::DOUBLE))", 4)} END AS t FROM p""",
)
def t_statistic(spark: SparkSession, sf: str) -> DataFrame:
    return T.t_statistic(T.group_moments(values(spark, sf))).select("feature", "t")


@query(
    "bh_fdr",
    f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE ((p_partkey * 7919) % 10007) / 10007.0::DOUBLE END AS p_value FROM part),
    r AS (SELECT *, p_value * count(*) OVER () / rank_max AS raw FROM (SELECT *, count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_max FROM p WHERE p_value IS NOT NULL))
    SELECT p.p_partkey, CASE WHEN m IS NOT NULL THEN {rhu("least(m, 1.0::DOUBLE)", 8)} END AS p_fdr FROM p LEFT JOIN (SELECT p_partkey, min(raw) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM r) USING (p_partkey)""",
)
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.pmod(F.col("p_partkey") * 7919, F.lit(10007)) / 10007.0).alias("p_value"))
    return T.benjamini_hochberg(p, digits=8).select("p_partkey", "p_fdr")


@query("scale_info_join", f"WITH {VALUES}, {MOMENTS}, {RANKS} SELECT feature, 'cat' || (substr(split_part(feature, '-', 3), 3)::INT % 3) AS category, 'sub' || (substr(split_part(feature, '-', 3), 3)::INT % 5) AS subcategory, 'generated scale ' || substr(split_part(feature, '-', 3), 3)::INT AS scale_name, abs_auc FROM auc")
def scale_info_join(spark: SparkSession, sf: str) -> DataFrame:
    auc = T.adjusted_auc(T.rank_sums(values(spark, sf)))
    return S.with_scale_info(auc, scale_metadata(spark, len(SCALES))).select("feature", "category", "subcategory", "scale_name", "abs_auc")


@query(
    "feature_enumeration",
    "WITH f AS (SELECT concat(p, '-Segment(', i, ',', n, ')-SC', lpad(s::VARCHAR, 2, '0')) AS feature, p AS part, n FROM (VALUES ('TMD'), ('JMD_N_TMD_N'), ('TMD_C_JMD_C')) v(p), range(1, 16) a(n), range(1, 16) b(i), range(0, 4) c(s) WHERE i <= n) SELECT feature, part, n::INT AS n_split FROM f",
)
def feature_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.createDataFrame([(p.upper(),) for p in PARTS], "part string")
    splits = spark.createDataFrame([(s.label, s.args[1]) for s in segments()], "split string, n_split int")
    scales = spark.createDataFrame([(s,) for s in SCALES], "scale_id string")
    every = parts.crossJoin(F.broadcast(splits)).crossJoin(F.broadcast(scales))
    return every.select(feature_id("part", "split", "scale_id").alias("feature"), "part", "n_split")


@query("feature_id_parse", f"WITH {VALUES}, d AS (SELECT DISTINCT feature FROM feats) SELECT feature, split_part(feature, '-', 1) AS part, split_part(feature, '-', 2) AS split, split_part(feature, '-', 3) AS scale_id FROM d")
def feature_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    ids = values(spark, sf).select("feature").distinct()
    return ids.withColumn("_s", split_feature_id(F.col("feature"))).select("feature", "_s.part", "_s.split", "_s.scale_id")


def _positions_sql() -> str:
    rows = ", ".join(f"('TMD-{s.label}-{c}', [{', '.join(str(10 + p) for p in s.positions(20))}])" for s in SEGMENTS + PATTERNS for c in SCALES)
    return f"WITH f(feature, ats) AS (VALUES {rows})"


@query("feature_positions", f"{_positions_sql()} SELECT feature, array_to_string(ats, ',') AS positions, list_min(ats)::INT AS first, list_max(ats)::INT AS last FROM f")
def feature_positions(spark: SparkSession, sf: str) -> DataFrame:
    return S.feature_positions(spark, ["tmd"], SEGMENTS + PATTERNS, list(SCALES)).select("feature", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), F.array_min("positions").alias("first"), F.array_max("positions").alias("last"))


@query(
    "feature_names",
    f"{_positions_sql()} SELECT feature, 'sub' || (substr(split_part(feature, '-', 3), 3)::INT % 5) || ' [' || CASE WHEN contains(feature, 'Segment') THEN list_min(ats) || '-' || list_max(ats) ELSE array_to_string(ats, '..') END || ']' AS name FROM f",
)
def feature_names(spark: SparkSession, sf: str) -> DataFrame:
    at = S.feature_positions(spark, ["tmd"], SEGMENTS + PATTERNS, list(SCALES))
    return S.feature_names(S.with_scale_info(at, scale_metadata(spark, len(SCALES)))).select("feature", "name")


def _df_feat(spark: SparkSession, sf: str) -> DataFrame:
    stats = T.feature_stats(values(spark, sf)).withColumn("_id", split_feature_id(F.col("feature")))
    at = S.feature_positions(spark, list(PARTS), SEGMENTS, list(SCALES))
    return S.with_scale_info(stats.drop("_id").join(F.broadcast(at), "feature"), scale_metadata(spark, len(SCALES)))


def _all_positions() -> str:
    from ..operators.select import part_positions

    rows = ", ".join(f"('{p.upper()}-{s.label}-{c}', {part_positions(p, s)}, 'cat{int(c[2:]) % 3}')" for p in PARTS for s in SEGMENTS for c in SCALES)
    return f"fp(feature, ats, category) AS (VALUES {rows})"


DF_FEAT = f"{VALUES}, {MOMENTS}, {RANKS}, st AS ({STATS}), {_all_positions()}, df_feat AS (SELECT st.*, ats, category FROM st JOIN fp USING (feature))"


@query("df_pos_mean", f"WITH {DF_FEAT} SELECT category, p::INT AS pos, {rhu('avg(mean_dif)', 9)} AS value FROM (SELECT category, mean_dif, unnest(ats) AS p FROM df_feat) GROUP BY category, p")
def df_pos_mean(spark: SparkSession, sf: str) -> DataFrame:
    return S.by_position(_df_feat(spark, sf), "mean_dif", "mean").withColumn("value", T.round_half_up(F.col("value"), 9))


@query("df_pos_sum", f"WITH {DF_FEAT} SELECT category, p::INT AS pos, {rhu('sum(abs_auc / n)', 5)} AS value FROM (SELECT category, abs_auc, len(ats) AS n, unnest(ats) AS p FROM df_feat) GROUP BY category, p")
def df_pos_sum(spark: SparkSession, sf: str) -> DataFrame:
    return S.by_position(_df_feat(spark, sf), "abs_auc", "sum").withColumn("value", T.round_half_up(F.col("value"), 5))


@query(
    "df_pos_parts",
    f"""WITH {DF_FEAT}, pv AS (SELECT category, p, sum(abs_auc / n) AS v FROM (SELECT category, abs_auc, len(ats) AS n, unnest(ats) AS p FROM df_feat) GROUP BY category, p)
    SELECT category, CASE WHEN p <= 10 THEN 'jmd_n' WHEN p <= 30 THEN 'tmd' ELSE 'jmd_c' END AS part, {rhu("sum(v)", 4)} AS value FROM pv GROUP BY 1, 2""",
)
def df_pos_parts(spark: SparkSession, sf: str) -> DataFrame:
    return S.by_part(S.by_position(_df_feat(spark, sf), "abs_auc", "sum"), "sum").withColumn("value", T.round_half_up(F.col("value"), 4))


@query("redundancy_greedy")
def redundancy_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return S.greedy_redundancy(_df_feat(spark, sf), SCALES, n=20)


@query("feature_selection_run")
def feature_selection_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole discovery query: values, moments, top-K, rank statistics of the survivors, p-values, redundancy."""
    return S.discover(values(spark, sf, SEGMENTS + PATTERNS), SCALES, scale_metadata(spark, len(SCALES)), S.feature_positions(spark, list(PARTS), SEGMENTS + PATTERNS, list(SCALES)), n=20)


#: As many scales as the usual table has, and the default splits: 586 x 3 parts x (120 segments + 182 patterns + 28 periodic patterns).
WIDE = {f"SC{s:02d}": scale_values(s) for s in range(586)}


@query("discover_wide")
def discover_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The discovery query at its usual width: some 580,000 features, of which the 1,000 with the largest mean difference are tested, and 100 kept."""
    parts = P.get_parts(labelled(spark, sf), PARTS, keep=("entry", "label"))
    return S.discover_wide(parts, PARTS, segments() + patterns() + periodic_patterns(), WIDE, scale_metadata(spark, len(WIDE)), 100, 1000)


@query("feature_kld")
def feature_kld(spark: SparkSession, sf: str) -> DataFrame:
    return T.kernel_divergence(values(spark, sf).filter("value IS NOT NULL"))


@query(
    "feature_set_eval",
    f"""WITH {DF_FEAT} SELECT category, count(*) AS n_features, {rhu("avg(abs_auc)", 5)} AS avg_abs_auc, {rhu("quantile_cont(abs_auc, 0.25)", 5)} AS q1, {rhu("quantile_cont(abs_auc, 0.75)", 5)} AS q3,
    {rhu("avg(mean_dif) FILTER (mean_dif > 0)", 6)} AS avg_pos, {rhu("avg(mean_dif) FILTER (mean_dif < 0)", 6)} AS avg_neg FROM df_feat GROUP BY category""",
)
def feature_set_eval(spark: SparkSession, sf: str) -> DataFrame:
    d = _df_feat(spark, sf)
    r = T.round_half_up
    return d.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_features"), r(F.avg("abs_auc"), 5).alias("avg_abs_auc"), r(F.percentile("abs_auc", 0.25), 5).alias("q1"), r(F.percentile("abs_auc", 0.75), 5).alias("q3"),
        r(F.avg(F.when(F.col("mean_dif") > 0, F.col("mean_dif"))), 6).alias("avg_pos"), r(F.avg(F.when(F.col("mean_dif") < 0, F.col("mean_dif"))), 6).alias("avg_neg"),
    )


@query(
    "grid_sweep",
    f"""WITH {BASE}, {features_sql()}, lab AS (SELECT doc_id AS entry, quality AS label FROM labels), cfg(config, n_max, part_filter) AS (VALUES ('c1', 1, 'TMD'), ('c2', 2, 'TMD'), ('c3', 3, 'TMD'), ('c4', 3, '%')),
    val0 AS (SELECT feats.*, label, regexp_extract(split, ',(\\d+)', 1)::INT AS n_split FROM feats JOIN lab USING (entry)), val AS (SELECT config || '|' || feature AS feature, value, label, config FROM val0 JOIN cfg ON n_split <= n_max AND part LIKE part_filter),
    {RANKS} SELECT split_part(feature, '|', 1) AS config, count(*) AS n_features, {rhu("avg(abs_auc)", 5)} AS avg_abs_auc, max(abs_auc) AS max_abs_auc FROM auc GROUP BY 1""",
)
def grid_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Feature values are computed once; the configurations are a small table that selects among their statistics."""
    auc = T.adjusted_auc(T.rank_sums(values(spark, sf))).withColumn("_id", split_feature_id(F.col("feature")))
    auc = auc.select("abs_auc", "_id.part", F.regexp_extract("_id.split", r",(\d+)", 1).cast("int").alias("n_split"))
    configs = spark.createDataFrame([("c1", 1, "TMD"), ("c2", 2, "TMD"), ("c3", 3, "TMD"), ("c4", 3, "%")], "config string, n_max int, part_filter string")
    chosen = auc.join(F.broadcast(configs), (F.col("n_split") <= F.col("n_max")) & F.expr("part LIKE part_filter"))
    return chosen.groupBy("config").agg(F.count(F.lit(1)).alias("n_features"), T.round_half_up(F.avg("abs_auc"), 5).alias("avg_abs_auc"), F.max("abs_auc").alias("max_abs_auc"))


@query("bootstrap_stability")
def bootstrap_stability(spark: SparkSession, sf: str) -> DataFrame:
    return S.selection_frequency(values(spark, sf), n=10, rounds=8)


