"""Queries over scale tables, sources, windows, feature frames and what charts are drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parts as P
from ..functions.alphabet import LETTERS, scales_table
from ..functions.splits import patterns, periodic_patterns
from ..operators import frames as R
from ..operators import scales as S
from ..operators import select as Q
from ..operators.stats import round_half_up as r
from .catalog import BASE, PATTERNS, SCALES, SEGMENTS, SEQ, load, query, rhu, sequences
from .core import DF_FEAT, VALUES, _df_feat, values
from .encoding import SCALE_ROWS


@query("scale_table_scan", f"WITH {SCALE_ROWS} SELECT aa, scale_id, value::DOUBLE AS value FROM lscales")
def scale_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table of scales, read as rows."""
    return S.long_scales(S.wide_scales(scales_table(spark, len(SCALES)), list(SCALES)))


_META = "meta AS (SELECT concat(CASE p_partkey % 7 WHEN 0 THEN 'LINS' WHEN 1 THEN 'KOEH' ELSE 'ANDN' END, p_partkey) AS scale_id, CASE WHEN p_size % 9 = 0 THEN 'Others' ELSE split_part(p_type, ' ', 1) END AS category, CASE WHEN p_size % 11 = 0 THEN 'Unclassified (' || p_brand || ')' ELSE p_brand END AS subcategory FROM part)"


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as the metadata of scales."""
    p = load(spark, sf, "part")
    prefix = F.when(F.col("p_partkey") % 7 == 0, "LINS").when(F.col("p_partkey") % 7 == 1, "KOEH").otherwise("ANDN")
    sub = F.when(F.col("p_size") % 11 == 0, F.concat(F.lit("Unclassified ("), "p_brand", F.lit(")"))).otherwise(F.col("p_brand"))
    return p.select(F.concat(prefix, F.col("p_partkey").cast("string")).alias("scale_id"), F.when(F.col("p_size") % 9 == 0, "Others").otherwise(F.split("p_type", " ")[0]).alias("category"), sub.alias("subcategory"))


@query("scale_filter", f"WITH {_META} SELECT * FROM meta WHERE NOT contains(scale_id, 'LINS') AND NOT contains(scale_id, 'KOEH') AND NOT contains(subcategory, 'Unclassified') AND category <> 'Others'")
def scale_filter(spark: SparkSession, sf: str) -> DataFrame:
    return S.filter_scales(metadata(spark, sf), unclassified_out=True, just_indexed=True)


@query("scale_pre_select", f"WITH {_META} SELECT scale_id FROM meta WHERE category <> 'PROMO' AND subcategory NOT IN ('Brand#11', 'Brand#23')")
def scale_pre_select(spark: SparkSession, sf: str) -> DataFrame:
    return S.pre_select(metadata(spark, sf), ["PROMO"], ["Brand#11", "Brand#23"]).select("scale_id")


_SUBCATS = "subs AS (SELECT DISTINCT p_brand AS subcategory, 'x' AS category, (length(p_brand) + ascii(right(p_brand, 1))) % 5 + 1 AS tier FROM part UNION ALL SELECT 'Unused', 'x', 2)"


def _subcategories(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.col("p_brand")
    subs = load(spark, sf, "part").select(brand.alias("subcategory"), F.lit("x").alias("category"), ((F.length(brand) + F.ascii(F.right(brand, F.lit(1)))) % 5 + 1).alias("tier")).distinct()
    return subs.unionByName(spark.createDataFrame([("Unused", "x", 2)], "subcategory string, category string, tier int"))


@query("subcategory_overview", f"WITH {_META}, {_SUBCATS} SELECT s.subcategory, tier::INT AS tier, count(scale_id) AS n_scales, count(scale_id) FILTER (NOT contains(scale_id, 'LINS') AND NOT contains(scale_id, 'KOEH')) AS n_scales_indexed FROM subs s LEFT JOIN meta USING (subcategory) GROUP BY ALL")
def subcategory_overview(spark: SparkSession, sf: str) -> DataFrame:
    return S.subcategory_overview(_subcategories(spark, sf), metadata(spark, sf)).select("subcategory", F.col("tier").cast("int").alias("tier"), "n_scales", "n_scales_indexed")


@query("explainability_tier", f"WITH {_META}, {_SUBCATS} SELECT scale_id FROM meta JOIN subs s USING (subcategory) WHERE tier <= 3 AND NOT contains(scale_id, 'LINS') AND NOT contains(scale_id, 'KOEH')")
def explainability_tier(spark: SparkSession, sf: str) -> DataFrame:
    return S.scales_of_tier(metadata(spark, sf), _subcategories(spark, sf), 3, just_indexed=True)


@query("listed_scales", "SELECT p_partkey, unnest(list_filter(string_split(concat('A', p_size, ';;B', p_partkey % 4), ';'), lambda x: x <> '')) AS scale_id FROM part")
def listed_scales(spark: SparkSession, sf: str) -> DataFrame:
    """A stored selection of scales: ids joined in one field."""
    text = F.concat(F.lit("A"), F.col("p_size").cast("string"), F.lit(";;B"), (F.col("p_partkey") % 4).cast("string"))
    return load(spark, sf, "part").select("p_partkey", F.explode(S.listed_ids(text)).alias("scale_id"))


@query("top_set_members", "SELECT 'Q' || i AS scale_id FROM range(1, 5) t(i) WHERE (SELECT sum(CASE i WHEN 1 THEN (l_quantity > 45)::INT WHEN 2 THEN (l_quantity > 60)::INT WHEN 3 THEN (l_discount > 0.09)::INT ELSE (l_tax > 0.5)::INT END) FROM lineitem WHERE l_linenumber = 3) > 0")
def top_set_members(spark: SparkSession, sf: str) -> DataFrame:
    """The scales of one of the stored sets: names of the columns that aren't 0 in its row."""
    flags = {"Q1": F.col("l_quantity") > 45, "Q2": F.col("l_quantity") > 60, "Q3": F.col("l_discount") > 0.09, "Q4": F.col("l_tax") > 0.5}
    sets = load(spark, sf, "lineitem").groupBy("l_linenumber").agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    return S.members_of_set(sets, "l_linenumber", 3)


@query("composition_scales", f"SELECT a.aa, 'AAC_' || b.aa AS scale_id, (a.aa = b.aa)::INT::DOUBLE AS value FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in LETTERS)}) a(aa), (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in LETTERS)}) b(aa)")
def composition_scales(spark: SparkSession, sf: str) -> DataFrame:
    return S.composition_scales(spark)


@query("coverage_selection", f"WITH {_META} SELECT {rhu('count(DISTINCT subcategory) FILTER (ends_with(scale_id, chr(55))) * 100.0::DOUBLE / count(DISTINCT subcategory)', 6)} AS coverage FROM meta")
def coverage_selection(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the subcategories a selection of scales covers."""
    m = metadata(spark, sf)
    return S.coverage_of(m, m.filter(F.endswith("scale_id", F.lit("7")))).select(r(F.col("coverage"), 6).alias("coverage"))


@query("split_labels", "WITH p AS (SELECT DISTINCT unnest(range(1, st + 1)) AS start, st, two FROM (VALUES (3), (4)) a(st), (VALUES (3), (4)) b(two)), per AS (SELECT concat('PeriodicPattern(', e, ',i+', st, '/', two, ',', start, ')') AS label FROM p, (VALUES ('N'), ('C')) t(e)), s2 AS (SELECT [a, a + b] AS ats FROM (VALUES (3), (4)) x(a), (VALUES (3), (4)) y(b)), s3 AS (SELECT [a, a + b, a + b + c] AS ats FROM (VALUES (3), (4)) x(a), (VALUES (3), (4)) y(b), (VALUES (3), (4)) z(c)), s4 AS (SELECT [a, a + b, a + b + c, a + b + c + d] AS ats FROM (VALUES (3), (4)) x(a), (VALUES (3), (4)) y(b), (VALUES (3), (4)) z(c), (VALUES (3), (4)) w(d)), al AS (SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4), sh AS (SELECT ats, unnest(range(1 - ats[1], 16 - ats[-1])) AS k FROM al), pat AS (SELECT DISTINCT concat('Pattern(', e, ',', array_to_string(list_transform(ats, lambda x: x + k), ','), ')') AS label FROM sh, (VALUES ('N'), ('C')) t(e)) SELECT label FROM per UNION ALL SELECT label FROM pat")
def split_labels(spark: SparkSession, sf: str) -> DataFrame:
    """All patterns and periodic patterns of the default configuration."""
    return spark.createDataFrame([(s.label,) for s in patterns() + periodic_patterns()], "label string")


@query("aa_window_even", f"WITH {SEQ}, w AS (SELECT entry, sequence, unnest(range(0, length(sequence))) AS i FROM seq WHERE length(sequence) > 8) SELECT concat(entry, '_', i, '|', i + 1) AS entry, substr(sequence, (i - 3)::INT, 8) AS sequence, (i % 3 = 1 AND i > 0)::INT AS label FROM w WHERE i >= 4 AND i + 4 <= length(sequence)")
def aa_window_even(spark: SparkSession, sf: str) -> DataFrame:
    """Windows around the bond between two residues; positive where both carry a label (here residues 0, 1, 3, 4, 6, ...)."""
    base = sequences(spark, sf).filter(F.length("sequence") > 8).select("entry", "sequence", F.transform(F.sequence(F.lit(0), F.length("sequence") - 1), lambda i: (i % 3 != 2).cast("int")).alias("labels"))
    return P.even_windows(base, 8)


@query("non_canonical_policy", f"WITH u AS (SELECT doc_id AS entry, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS s FROM documents) SELECT entry, length(s) AS kept, CASE WHEN NOT regexp_matches(s, '[^{LETTERS}]') THEN length(s) END AS removed, length(s) - length(replace(regexp_replace(s, '[^{LETTERS}]', '-', 'g'), '-', '')) AS gaps FROM u")
def non_canonical_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences under the three policies: keep, remove (null here), gap."""
    u = load(spark, sf, "documents").select(F.col("doc_id").alias("entry"), F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("sequence"))
    keep, gap = P.apply_policy(u, "keep"), P.apply_policy(u, "gap").withColumnRenamed("sequence", "g")
    gone = P.apply_policy(u, "remove").select("entry", F.length("sequence").cast("long").alias("removed"))
    gaps = (F.length("g") - F.length(F.replace("g", F.lit("-"), F.lit("")))).cast("long").alias("gaps")
    return keep.join(gap, "entry").join(gone, "entry", "left").select("entry", F.length("sequence").cast("long").alias("kept"), "removed", gaps)


@query("parts_from_windows", f"WITH {SEQ}, w AS (SELECT row_number() OVER (ORDER BY entry) - 1 AS i, entry, substr(sequence, 1, 10) AS a, substr(sequence, 11, 20) AS b FROM seq WHERE length(sequence) >= 30), x AS (SELECT row_number() OVER (ORDER BY entry) - 1 AS i, substr(sequence, 3, 10) AS c FROM seq WHERE length(sequence) >= 200) SELECT concat('REF', i) AS entry, a AS jmd_n, b AS tmd, c AS jmd_c FROM w JOIN x USING (i)")
def parts_from_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Parts put together from window sets, position by position; the shortest set decides how many there are."""
    s = sequences(spark, sf).select("entry", "sequence")
    take = lambda least, start, n: s.filter(F.length("sequence") >= least).select("entry", F.substring("sequence", start, n).alias("window"))
    return P.parts_of_windows({"jmd_n": take(30, 1, 10), "tmd": take(30, 11, 20), "jmd_c": take(200, 3, 10)}, "entry")


@query("pad_parts_frame", f"WITH {BASE}, m AS (SELECT max(length(tmd_n)) AS a, max(length(tmd_c)) AS b FROM parts) SELECT entry, rpad(tmd_n, a::INT, '-') AS tmd_n, rpad(tmd_c, b::INT, '-') AS tmd_c FROM parts, m")
def pad_parts_frame(spark: SparkSession, sf: str) -> DataFrame:
    return P.pad_frame(P.get_parts(sequences(spark, sf), ("tmd_n", "tmd_c")), ("tmd_n", "tmd_c"))


@query("aa_window_between", f"WITH {SEQ} SELECT entry, rpad(substr(sequence, 6, 12), 12, '-') AS by_stop, rpad(substr(sequence, 5, 12), 12, '-') AS from_one FROM seq")
def aa_window_between(spark: SparkSession, sf: str) -> DataFrame:
    """Windows by first and last position, counted from 0 and from 1."""
    s = F.col("sequence")
    return sequences(spark, sf).select("entry", P.window_between(s, 5, 16).alias("by_stop"), P.window_between(s, 5, 16, index1=True).alias("from_one"))


@query("sliding_windows_between", f"WITH {SEQ}, p AS (SELECT entry, sequence, unnest(range(3, least(40, length(sequence)) - 4)) AS i FROM seq WHERE length(sequence) >= 8) SELECT entry, i::INT AS start, substr(sequence, (i + 1)::INT, 5) AS \"window\" FROM p")
def sliding_windows_between(spark: SparkSession, sf: str) -> DataFrame:
    """All windows of 5 from position 3 to 39 (from 0)."""
    s = sequences(spark, sf).filter(F.length("sequence") >= 8)
    return s.select("entry", F.explode(P.windows_between(F.col("sequence"), 5, 3, 39)).alias("_w")).select("entry", "_w.start", "_w.window")


@query("seq_kws_lookup", f"WITH {BASE} SELECT entry, jmd_n, tmd, jmd_c FROM parts WHERE entry = 7")
def seq_kws_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of one sample: the filter reaches the scan."""
    return P.get_parts(sequences(spark, sf).filter("entry = 7"), ("jmd_n", "tmd", "jmd_c"))


def _letters_sql(splits: list) -> str:
    rows = ", ".join(f"('TMD-{s.label}', [{', '.join(map(str, s.positions(20)))}])" for s in splits)
    return f"f(feature, ats) AS (VALUES {rows})"


@query("feature_amino_acids", f"WITH {BASE}, {_letters_sql(SEGMENTS + PATTERNS)} SELECT entry, feature, CASE WHEN contains(feature, 'Segment') THEN array_to_string(list_transform(ats, lambda p: substr(tmd, p, 1)), '') ELSE array_to_string(list_transform(ats, lambda p: substr(tmd, p, 1)), '-') END AS letters FROM parts, f WHERE length(tmd) >= 20")
def feature_amino_acids(spark: SparkSession, sf: str) -> DataFrame:
    """The letters that features of a middle of 20 letters stand on."""
    at = spark.createDataFrame([(f"TMD-{s.label}", s.positions(20)) for s in SEGMENTS + PATTERNS], "feature string, positions array<int>")
    parts = P.get_parts(sequences(spark, sf), ("tmd",)).filter(F.length("tmd") >= 20).withColumn("_s", F.substring("tmd", 1, 20))
    return parts.crossJoin(F.broadcast(at)).select("entry", "feature", R.feature_letters(F.col("_s"), F.col("positions"), F.col("feature")).alias("letters"))


@query("feature_descriptions", f"WITH {DF_FEAT} SELECT feature, concat('Mean of generated scale ', substr(split_part(feature, '-', 3), 3)::INT, ' (sub', substr(split_part(feature, '-', 3), 3)::INT % 5, ') over a segment of ', split_part(feature, '-', 1), ' at positions ', list_min(ats), '-', list_max(ats)) AS description FROM df_feat")
def feature_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return R.feature_descriptions(_df_feat(spark, sf)).select("feature", "description")


@query("df_feat_given", f"WITH {DF_FEAT} SELECT feature, category, abs_auc, abs_mean_dif, mean_dif, std_test, std_ref, array_to_string(ats, ',') AS positions FROM df_feat WHERE contains(feature, 'Segment(2,3)')")
def df_feat_given(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table of given features, its columns in order."""
    d = _df_feat(spark, sf).filter(F.contains("feature", F.lit("Segment(2,3)"))).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))
    return R.sort_columns(d).select("feature", "category", "abs_auc", "abs_mean_dif", "mean_dif", "std_test", "std_ref", "positions")


# Importance and impact: the parts' lines stand for contributions of features to samples

_CONTRIB = "con AS (SELECT l_suppkey AS sample, 'f' || l_linenumber AS feature, l_returnflag AS grp, sum((l_quantity * 10)::BIGINT - 250)::DOUBLE AS value FROM lineitem GROUP BY 1, 2, 3)"


def _contributions(spark: SparkSession, sf: str) -> DataFrame:
    line = load(spark, sf, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("sample"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature"), F.col("l_returnflag").alias("grp")).agg(F.sum((F.col("l_quantity") * 10).cast("long") - 250).cast("double").alias("value"))


@query("impact_by_sample", f"WITH {_CONTRIB}, s AS (SELECT sample, feature, sum(value) AS value FROM con GROUP BY ALL) SELECT sample, feature, {rhu('value / sum(abs(value)) OVER (PARTITION BY sample) * 100', 6)} AS feat_impact FROM s")
def impact_by_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = _contributions(spark, sf).groupBy("sample", "feature").agg(F.sum("value").alias("value"))
    return R.impact(c).withColumn("feat_impact", r(F.col("feat_impact"), 6))


@query("impact_by_group", f"WITH {_CONTRIB}, m AS (SELECT grp, feature, avg(value) AS m, stddev_pop(value) AS s FROM con GROUP BY grp, feature) SELECT grp, feature, {rhu('m / sum(abs(m)) OVER (PARTITION BY grp) * 100', 5)} AS feat_impact, {rhu('s / sum(abs(m)) OVER (PARTITION BY grp) * 100', 4)} AS feat_impact_std FROM m")
def impact_by_group(spark: SparkSession, sf: str) -> DataFrame:
    g = R.group_impact(_contributions(spark, sf), "grp")
    return g.select("grp", "feature", r(F.col("feat_impact"), 5).alias("feat_impact"), r(F.col("feat_impact_std"), 4).alias("feat_impact_std"))


@query("impact_importance", f"WITH {_CONTRIB}, m AS (SELECT feature, avg(abs(value)) AS m FROM con GROUP BY feature) SELECT feature, {rhu('m / sum(m) OVER () * 100', 6)} AS feat_importance FROM m")
def impact_importance(spark: SparkSession, sf: str) -> DataFrame:
    return R.importance_of_contributions(_contributions(spark, sf)).withColumn("feat_importance", r(F.col("feat_importance"), 6))


@query("sample_mean_dif", f"WITH {VALUES}, rf AS (SELECT feature, avg(value) AS m FROM val WHERE label = 0 GROUP BY feature) SELECT entry, feature, {rhu('value - m', 6)} AS mean_dif FROM val JOIN rf USING (feature)")
def sample_mean_dif(spark: SparkSession, sf: str) -> DataFrame:
    return R.sample_mean_dif(values(spark, sf)).withColumn("mean_dif", r(F.col("mean_dif"), 6))


@query("add_importance", f"WITH {DF_FEAT}, im AS (SELECT feature, abs_auc + 0.001 AS i, abs_auc / 10 AS s FROM df_feat WHERE abs_auc > 0.01) SELECT feature, coalesce({rhu('i / sum(i) OVER () * 100', 6)}, 0) AS feat_importance, coalesce({rhu('s / sum(i) OVER () * 100', 6)}, 0) AS feat_importance_std FROM df_feat LEFT JOIN im USING (feature)")
def add_importance(spark: SparkSession, sf: str) -> DataFrame:
    d = _df_feat(spark, sf)
    given = d.filter("abs_auc > 0.01").select("feature", (F.col("abs_auc") + 0.001).alias("importance"), (F.col("abs_auc") / 10).alias("std"))
    return R.add_importance(d, given).select("feature", *[r(F.col(c), 6).alias(c) for c in ("feat_importance", "feat_importance_std")])


@query("select_features", f"WITH {DF_FEAT} (SELECT feature, 'top_k' AS strategy FROM df_feat ORDER BY abs_auc DESC, feature LIMIT 10) UNION ALL SELECT feature, 'threshold' FROM df_feat WHERE abs_auc >= 0.02")
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    d = _df_feat(spark, sf)
    top, high = R.select_features(d, "top_k", 10, "abs_auc"), R.select_features(d, "threshold", 0.02, "abs_auc")
    return top.select("feature", F.lit("top_k").alias("strategy")).unionByName(high.select("feature", F.lit("threshold").alias("strategy")))


# What charts are drawn from


@query("chart_ranking", f"WITH {DF_FEAT} SELECT row_number() OVER (ORDER BY abs_auc DESC, feature)::INT AS rank, feature, mean_dif, abs_auc AS value, len(ats)::INT AS n_positions FROM df_feat ORDER BY rank LIMIT 15")
def chart_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranking_frame(_df_feat(spark, sf)).select("rank", "feature", "mean_dif", "value", F.size("positions").alias("n_positions"))


@query("chart_heatmap", f"WITH {DF_FEAT}, s AS (SELECT *, 'sub' || (substr(split_part(feature, '-', 3), 3)::INT % 5) AS subcategory FROM df_feat), v AS (SELECT subcategory, unnest(ats)::INT AS pos, mean_dif FROM s), m AS (SELECT subcategory, pos, avg(mean_dif) AS value FROM v GROUP BY ALL) SELECT g.subcategory, g.pos::INT AS pos, {rhu('coalesce(value, 0)', 9)} AS value FROM (SELECT DISTINCT subcategory, p.pos FROM s, range(1, 41) p(pos)) g LEFT JOIN m USING (subcategory, pos)")
def chart_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return R.position_frame(_df_feat(spark, sf)).withColumn("value", r(F.col("value"), 9))


@query("chart_profile", f"WITH {DF_FEAT}, v AS (SELECT unnest(ats)::INT AS pos, abs_auc / len(ats) AS x, mean_dif FROM df_feat), s AS (SELECT pos, sum(CASE WHEN mean_dif >= 0 THEN x ELSE 0 END) AS p, sum(CASE WHEN mean_dif < 0 THEN -x ELSE 0 END) AS n FROM v GROUP BY pos) SELECT g.pos::INT AS pos, {rhu('coalesce(p, 0)', 8)} AS positive, {rhu('coalesce(n, 0)', 8)} AS negative FROM range(1, 41) g(pos) LEFT JOIN s USING (pos)")
def chart_profile(spark: SparkSession, sf: str) -> DataFrame:
    return R.profile_frame(_df_feat(spark, sf)).select("pos", *[r(F.col(c), 8).alias(c) for c in ("positive", "negative")])


@query("chart_feature_density", f"WITH {VALUES}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM val GROUP BY feature), b AS (SELECT feature, label, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 20), 19) ELSE 0 END::INT AS bin FROM val JOIN e USING (feature) WHERE value IS NOT NULL) SELECT feature, label, bin, {rhu('count(*) / sum(count(*)) OVER (PARTITION BY feature, label)::DOUBLE', 9)} AS share FROM b GROUP BY feature, label, bin")
def chart_feature_density(spark: SparkSession, sf: str) -> DataFrame:
    return R.density_frame(values(spark, sf)).withColumn("share", r(F.col("share"), 9))


@query("chart_substitution_matrix", f"WITH {SCALE_ROWS}, d AS (SELECT a.aa AS from_aa, b.aa AS to_aa, avg(abs(b.value - a.value)) AS v FROM lscales a JOIN lscales b ON a.scale_id = b.scale_id AND a.aa <> b.aa GROUP BY ALL) PIVOT d ON to_aa IN ({', '.join(repr(a) for a in LETTERS)}) USING first(v) GROUP BY from_aa")
def chart_substitution_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Mean change over all scales of each letter into each other, as a matrix."""
    from ..operators.mutation import substitution_impact

    mean = substitution_impact(scales_table(spark, len(SCALES))).groupBy("from_aa", "to_aa").agg(F.avg("abs_delta").alias("v"))
    return R.matrix_frame(mean, "from_aa", "to_aa", "v", list(LETTERS))


@query("chart_scale_bars", f"WITH {SCALE_ROWS}, s AS (SELECT a.scale_id, sum(abs(b.value - a.value))::DOUBLE AS value FROM lscales a JOIN lscales b ON a.scale_id = b.scale_id AND a.aa <> b.aa GROUP BY 1) SELECT scale_id, value, {rhu('value / sum(value) OVER ()', 8)} AS share FROM s ORDER BY value DESC, scale_id LIMIT 3")
def chart_scale_bars(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.mutation import substitution_impact

    bars = R.bar_frame(substitution_impact(scales_table(spark, len(SCALES))).withColumn("abs_delta", F.col("abs_delta").cast("double")), "scale_id", "abs_delta", 3)
    return bars.withColumn("share", r(F.col("share"), 8))


@query("chart_category_parts", f"WITH {DF_FEAT}, v AS (SELECT category, unnest(ats) AS p, abs_auc / len(ats) AS x FROM df_feat), s AS (SELECT category, CASE WHEN p <= 10 THEN 'jmd_n' WHEN p <= 30 THEN 'tmd' ELSE 'jmd_c' END AS part, sum(x) AS v FROM v GROUP BY 1, 2) SELECT category, {rhu('sum(v) FILTER (part = chr(106) || chr(109) || chr(100) || chr(95) || chr(110))', 6)} AS jmd_n, {rhu('sum(v) FILTER (length(part) = 3)', 6)} AS tmd, {rhu('sum(v) FILTER (ends_with(part, chr(99)))', 6)} AS jmd_c FROM s GROUP BY category")
def chart_category_parts(spark: SparkSession, sf: str) -> DataFrame:
    """What each category adds in each part, as a matrix."""
    by = Q.by_part(Q.by_position(_df_feat(spark, sf), "abs_auc", "sum"), "sum")
    return R.matrix_frame(by, "category", "part", "value", ["jmd_n", "tmd", "jmd_c"]).select("category", *[r(F.col(c), 6).alias(c) for c in ("jmd_n", "tmd", "jmd_c")])
