"""Discovery at full width, mutation scans, choice, structures and sources against plain loops and known numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import parts as P
from seqloom.functions.alphabet import LETTERS, scale_metadata, scale_values
from seqloom.functions.splits import patterns, periodic_patterns, segments
from seqloom.operators import choice as C
from seqloom.operators import features as X
from seqloom.operators import frames as R
from seqloom.operators import matrix as A
from seqloom.operators import metrics as M
from seqloom.operators import mutation as U
from seqloom.operators import select as S
from seqloom.operators import stats as T
from seqloom.operators import structure as Z
from seqloom.operators import windows as W

SCALES = {f"SC{s:02d}": scale_values(s) for s in range(3)}
PARTS = ("tmd", "jmd_n_tmd_n", "tmd_c_jmd_c")


@pytest.fixture(scope="module")
def df_seq(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randrange(25, 70))), i % 2) for i in range(40)]
    rows += [(100, "", 0), (101, "ACD", 1)]
    df = spark.createDataFrame(rows, "entry long, sequence string, label int")
    n = F.length("sequence")
    return df.withColumns({"tmd_start": (F.floor(n / 4) + 1).cast("int"), "tmd_stop": F.floor(n * 3 / 4).cast("int")})


def test_values_in_batches_equal_the_expressions(spark, df_seq):
    parts = P.get_parts(df_seq, PARTS, keep=("entry", "label"))
    splits = segments(1, 5) + patterns((3, 4), 2, 3, 10)[:9] + periodic_patterns()[:7]
    want = {(r.entry, r.feature): r.value for r in X.feature_values(X.split_letters(parts, PARTS, splits), SCALES).collect()}
    got = {(r.entry, r.feature): r.value for r in A.matrix_values(parts, PARTS, splits, SCALES).collect()}
    assert got == want and len(got) == 42 * 3 * len(splits) * 3
    some = {r.feature for r in A.matrix_values(parts, PARTS, splits, SCALES, only=[0, 5, 40]).collect()}
    assert len(some) == 3


def test_moments_without_rows_equal_those_of_values(spark, df_seq):
    parts = P.get_parts(df_seq, PARTS, keep=("entry", "label"))
    splits = segments(1, 4)
    values = A.matrix_values(parts, PARTS, splits, SCALES, ("entry", "label"))
    cols = ["feature", "n_test", "sum_test", "sq_test", "n_ref", "sum_ref", "sq_ref"]
    want = {tuple(r) for r in T.group_moments(values).select(*cols).fillna(0).collect()}
    assert {tuple(r) for r in A.matrix_moments(parts, PARTS, splits, SCALES).select(*cols).collect()} == want
    one = A.matrix_moments(parts.filter("label = 1").withColumn("label", F.when(F.col("entry") > 5, F.col("label"))), PARTS, splits, SCALES)  # no reference rows, and rows without a label
    assert {(r.n_ref, r.sum_ref) for r in one.collect()} == {(0, 0)} and one.agg(F.max("n_test")).first()[0] == 18


def test_discovery_of_survivors_equals_discovery_of_all(spark, df_seq):
    parts = P.get_parts(df_seq, PARTS, keep=("entry", "label"))
    splits, names = segments(1, 4), {f"SC{s:02d}": scale_values(s) for s in range(8)}
    got = S.discover_wide(parts, PARTS, splits, names, scale_metadata(spark, 8), n=12, n_pre=60).orderBy("rank").collect()
    values = A.matrix_values(parts, PARTS, splits, names, ("entry", "label"))
    top = {r.feature for r in S.prefilter(T.finalize_moments(T.group_moments(values)), 0.2, 60).collect()}
    stats = {r.feature: r for r in T.feature_stats(values.filter(F.col("feature").isin(*top))).collect()}
    kept = []
    for f in sorted(stats, key=lambda f: (-stats[f].abs_auc, -stats[f].abs_mean_dif, f)):
        part, split, scale = f.split("-")
        at = set(S.part_positions(part.lower(), next(s for s in splits if s.label == split)))
        clash = any(int(scale[2:]) % 3 == int(k[2][2:]) % 3 and (len(at & k[1]) / len(at | k[1]) >= 0.5 or at <= k[1]) and S.pearson(names[scale], names[k[2]]) > 0.5 for k in kept)
        if not clash:
            kept.append((f, at, scale))
    assert [r.feature for r in got] == [f for f, _, _ in kept[:12]]


def test_bounds_leave_no_feature_out_that_may_pass(spark, df_seq, monkeypatch):
    parts = P.get_parts(df_seq, PARTS, keep=("entry", "label"))
    splits, names = segments(1, 3) + patterns()[:20] + periodic_patterns()[:9], {f"SC{s:02d}": scale_values(s) for s in range(12)}
    exact = {r.number: r for r in T.finalize_moments(A.matrix_moments(parts, PARTS, splits, names)).collect()}
    bounds = {r.number: r for r in A.matrix_bounds(parts, PARTS, splits, names, 0.2).collect()}
    assert {k for k, r in exact.items() if r.std_test <= 0.2} <= set(bounds) and {k for k, b in bounds.items() if b.sure} <= {k for k, r in exact.items() if r.std_test <= 0.2}
    assert all(b.low <= exact[k].abs_mean_dif <= b.high and b.high - b.low < 3e-5 for k, b in bounds.items())
    only = S.may_pass(A.matrix_bounds(parts, PARTS, splits, names, 0.2), 40)
    assert len(only) < len(exact) / 4 and {r.number for r in S.prefilter(T.finalize_moments(A.matrix_moments(parts, PARTS, splits, names)), 0.2, 40).collect()} <= set(only)
    assert {tuple(r) for r in A.matrix_moments(parts, PARTS, splits, names, only=only).collect()} == {tuple(r) for r in A.matrix_moments(parts, PARTS, splits, names).collect() if r.number in set(only)}
    want = S.discover_wide(parts, PARTS, splits, names, scale_metadata(spark, 12), n=12, n_pre=40).collect()
    monkeypatch.setattr(S, "MOST_ADDED", 0)
    assert S.discover_wide(parts, PARTS, splits, names, scale_metadata(spark, 12), n=12, n_pre=40).collect() == want and want


def test_letters_held_at_once_are_bounded(spark, df_seq, monkeypatch):
    parts = P.get_parts(df_seq, PARTS, keep=("entry", "label"))
    want = A.matrix_values(parts, PARTS, segments(1, 3), SCALES, only=[0, 5, 40]).collect()
    monkeypatch.setattr(A, "_LETTERS_AT_ONCE", 100)
    batch = parts.select(*PARTS).toArrow().combine_chunks().to_batches()[0]
    cut = list(A._slices(batch, PARTS, 1))
    assert sum(c.num_rows for c in cut) == batch.num_rows and all(c.num_rows == 1 or sum(len(x) for p in PARTS for x in c.column(p).to_pylist()) <= 100 for c in cut)
    assert A.matrix_values(parts, PARTS, segments(1, 3), SCALES, only=[0, 5, 40]).collect() == want


def test_statistics_of_chosen_features_need_no_row_per_value(spark, df_seq, monkeypatch):
    parts = P.get_parts(df_seq, PARTS, keep=("entry", "label"))
    parts = parts.unionByName(parts.withColumn("label", F.lit(None).cast("int"))).unionByName(parts.limit(3).withColumn("tmd", F.lit("")))
    only = [0, 3, 7, 20, 50]
    monkeypatch.setattr(A, "_COUNTED", 30)
    got = A.matrix_sums(parts, PARTS, segments(1, 3) + periodic_patterns()[:4], SCALES, only)
    values = A.matrix_values(parts, PARTS, segments(1, 3) + periodic_patterns()[:4], SCALES, ("entry", "label"), only)
    told = lambda df: sorted(tuple(r) for r in df.collect())
    assert told(T.named_stats(T.stats_of_sums(got))) == told(T.feature_stats(values))
    assert told(T.named_stats(T.stats_of_sums(got, True), True)) == told(T.feature_stats(values, parametric=True))


def test_bands_of_centers_need_no_row_per_center(spark):
    rng = random.Random(3)
    rows = [(i % 25, "".join(rng.choices("WHAC", k=rng.choice([0, 5, 9, 40, 90])))) for i in range(60)] + [(99, None), (98, "A" * 30)]
    df = spark.createDataFrame(rows, "entry long, sequence string")
    every = W.explode_centers(W.motif_positions(df, "WH").filter(F.size("pos") > 0), 9, min_distance=3, max_distance=20)
    want = every.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"))
    told = lambda d: {tuple(r) for r in d.collect()}
    assert told(W.center_bands(df, 9, "WH", 3, 20)) == told(want) and want.count() > 5
    assert W.center_bands(df, 9, "WH", 3, 20)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_silhouette_hands_on_one_row_per_row_and_block(spark):
    rng = np.random.default_rng(5)
    x, lab = rng.normal(size=(90, 6)), rng.integers(0, 4, size=90)
    lab[0] = 9  # alone in its cluster
    df = spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, lab, strict=True))], "id long, v array<double>, c int")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = [0.0]
    for i in range(1, 90):
        a = far[i][(lab == lab[i]) & (np.arange(90) != i)].mean()
        b = min(far[i][lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    for block in (20, 1 << 18):
        got = C.silhouette(df, "id", "c", "v", block)
        assert math.isclose(got.first().sc, np.mean(s), rel_tol=1e-7)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == -(-90 // block)
        assert "_other" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert C.silhouette(df.filter("id < 0"), "id", "c", "v").first().sc is None


def test_tensors_made_where_sequences_are_read(spark, monkeypatch):
    from seqloom.operators import numeric as N

    rng = random.Random(8)
    rows = [(i % 30, "".join(rng.choices(LETTERS + "X", k=n))) for i, n in enumerate([1, 2, 3, 5, 8, 13, 40, 41, 90, 300] * 4)]
    df = spark.createDataFrame([(k, s, len(s) // 4 + 1, len(s) * 3 // 4) for k, s in rows], "entry long, sequence string, tmd_start int, tmd_stop int")
    scales, parts, splits = {"D1": SCALES["SC00"], "D2": SCALES["SC01"]}, ("tmd", "tmd_jmd", "jmd_n_tmd_n", "tmd_c_jmd_c", "jmd_c"), segments(1, 4) + patterns()[:3] + periodic_patterns()[:2]
    made = N.tensor_parts(df.withColumn("t", N.residue_tensor(F.col("sequence"), scales)), "t", parts, 2)
    told = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    monkeypatch.setattr(N, "_LETTERS_AT_ONCE", 70)
    read = list(N._read(iter(df.toArrow().to_batches()), "sequence"))
    assert len(read) > 8 and all(at[0] == 0 and at[-1] == len(codes) and (len(codes) <= 70 or part.num_rows == 1) for part, codes, at in read)
    assert [len(x) for _, x in rows] == [n for _, _, at in read for n in np.diff(at)]
    got = N.residue_values(df, parts, splits, scales)
    assert told(got) == told(N.tensor_values(made, parts, splits, ("D1", "D2"))) and "transform" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tensors_of_one_row_need_no_join(spark):
    from seqloom.operators import numeric as N

    rows = [(1, "ACXW"), (2, ""), (3, "Y"), (3, "AA")]
    df = spark.createDataFrame(rows, "entry long, sequence string")
    t = N.scale_tensor({"D1": SCALES["SC00"], "D2": SCALES["SC01"]})
    both = N.combined_of(df, "sequence", [t, lambda codes: t(codes)[:, ::-1]])
    of = lambda x: sum(SCALES[s][LETTERS.index(a)] / 1e5 for a in x if a != "X" for s in ("SC00", "SC01")) * 2
    assert [(r.entry, r.n, r.dims) for r in both.collect()] == [(k, len(x), 4 if x else None) for k, x in rows]
    assert all(math.isclose(r.total, of(x), abs_tol=1e-9) for r, (_, x) in zip(both.collect(), rows, strict=True))
    assert not {"Join", "Exchange"} & set(both._jdf.queryExecution().optimizedPlan().toString().split())
    with pytest.raises(Exception, match="other lengths"):
        N.combined_of(df, "sequence", [t, lambda codes: t(codes[1:])]).collect()


def test_p_values():
    assert abs(T.beta_fraction(2.0, 0.5, 0.3) - (1 - math.sqrt(0.7) * 1.15)) < 1e-12
    t = lambda v, df: T.beta_fraction(df / 2, 0.5, df / (df + v * v))
    assert abs(t(2.228138852, 10) - 0.05) < 1e-9 and abs(t(12.706204736, 1) - 0.05) < 1e-9 and abs(t(1.959963985, 1e7) - 0.05) < 1e-6


def test_erfc_and_tests_of_two_groups(spark):
    x = spark.range(0, 120).select((F.col("id") / 10).alias("x"))
    for r in x.select("x", T.erfc(F.col("x")).alias("e")).collect():
        assert math.isclose(r.e, math.erfc(r.x), rel_tol=1e-11)
    rows = [("f", float(v), g) for g, vs in ((1, [3, 4, 5, 5]), (0, [1, 2, 2, 4, 5])) for v in vs]
    values = spark.createDataFrame(rows, "feature string, value double, label int")
    s = T.feature_stats(values).first()
    u = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in (3, 4, 5, 5) for b in (1, 2, 2, 4, 5))
    z = (min(u, 20 - u) - 10) / math.sqrt(20 * 10 / 12)
    assert math.isclose(s.p_val_mann_whitney, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-10) and s.p_val_fdr_bh == s.p_val_mann_whitney
    assert math.isclose(s.abs_auc, abs(u / 20 - 0.5), abs_tol=1e-3) and math.isclose(s.mean_dif, 4.25 - 2.8, abs_tol=1e-6)
    p = T.feature_stats(values, parametric=True).first().p_val_ttest_indep
    a, b = np.array([3, 4, 5, 5.0]), np.array([1, 2, 2, 4, 5.0])
    pooled = (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / 7
    t = (a.mean() - b.mean()) / math.sqrt(pooled * (1 / 4 + 1 / 5))
    assert math.isclose(p, T.beta_fraction(3.5, 0.5, 7 / (7 + t * t)), rel_tol=1e-6)


def test_scan_of_changes_is_the_difference_of_feature_values(spark, df_seq):
    features = [("tmd", segments(2, 2)[1], "SC00", 1.0), ("jmd_n_tmd_n", segments(3, 3)[0], "SC01", -2.0), ("tmd_c_jmd_c", patterns((3, 4), 2, 2, 10)[-1], "SC02", 1.0)]
    base = df_seq.filter("entry < 3")
    got = {(r.entry, r.pos, r.to_aa): (r.delta_cpp, r.shift_score) for r in U.feature_scan(base, features, SCALES, "AW").collect()}
    rows = {r.entry: r for r in base.collect()}
    muts = [(e * 1000 + p, r.sequence[: p - 1] + a + r.sequence[p:], r.tmd_start, r.tmd_stop, e, p, a) for e, r in rows.items() for p in range(1, len(r.sequence) + 1) for a in "AW" if r.sequence[p - 1] != a]
    frame = spark.createDataFrame([(f"{m[4]}:{m[5]}:{m[6]}", *m[1:4]) for m in muts] + [(f"{e}", r.sequence, r.tmd_start, r.tmd_stop) for e, r in rows.items()], "entry string, sequence string, tmd_start int, tmd_stop int")
    used = [f"{p.upper()}-{s.label}-{c}" for p, s, c, _ in features]
    value = {(r.entry, r.feature): r.value for r in A.matrix_values(P.get_parts(frame, PARTS), PARTS, [f[1] for f in features], SCALES).filter(F.col("feature").isin(*used)).collect()}
    assert len(got) == len(muts)
    for _, _, _, _, e, p, a in muts:
        moved = [(value[f"{e}:{p}:{a}", f] or 0) - (value[str(e), f] or 0) for f in used]
        delta, shift = sum(map(abs, moved)), sum(d * f[3] for d, f in zip(moved, features, strict=True))
        assert math.isclose(got[e, p, a][0], delta, abs_tol=1e-9) and math.isclose(got[e, p, a][1], shift, abs_tol=1e-9)


def _scanned(spark, df_seq):
    features = [("tmd", segments(2, 2)[1], "SC00", 1.0), ("jmd_n_tmd_n", segments(3, 3)[0], "SC01", -2.0), ("tmd_c_jmd_c", patterns((3, 4), 2, 2, 10)[-1], "SC02", 1.0)]
    rows = U.feature_scan(df_seq, features, SCALES).collect()
    return features, [(r.entry, r.pos, r.from_aa, r.to_aa, r.region, round(r.delta_cpp * 1e5), round(r.shift_score * 1e5)) for r in rows]


def test_sums_of_a_scan_are_those_of_its_rows(spark, df_seq):
    features, rows = _scanned(spark, df_seq)
    want: dict = {}
    for entry, _, _, to, region, delta, shift in rows:
        n, d, most, best = want.get((entry, region, to), (0, 0, 0, -1e9))
        want[entry, region, to] = (n + 1, d + delta, max(most, delta), max(best, shift))
    got = {(r.entry, r.region, r.to_aa): (r.n, r.delta, r.most, r.best_shift) for r in U.scan_sums(df_seq, features, SCALES, ("region", "to_aa")).collect()}
    assert got == want and len(got) > 100


def test_totals_of_a_scan_are_those_of_its_rows(spark, df_seq):
    features, rows = _scanned(spark, df_seq)
    want: dict = {}
    for _, _, one, to, region, delta, _ in rows:
        n, d = want.get((region, one, to), (0, 0))
        want[region, one, to] = (n + 1, d + delta)
    assert {(r.region, r.from_aa, r.to_aa): (r.n, r.delta) for r in U.scan_totals(df_seq, features, SCALES).collect()} == want


def test_best_of_a_scan_are_those_of_its_rows(spark, df_seq):
    features, rows = _scanned(spark, df_seq)
    best = [(-s, e, p, to) for e, p, _, to, _, _, s in rows]
    got = [(-r.shift, r.entry, r.pos, r.to_aa) for r in U.scan_best(df_seq, features, SCALES, 25, each=False).collect()]
    assert got == sorted(best)[:25]
    for n in (1, 3, 40):
        want = {(e, k + 1, p, to, -d) for e in {r[0] for r in rows} for k, (d, p, to) in enumerate(sorted((-d, p, to) for x, p, _, to, _, d, _ in rows if x == e)[:n])}
        assert {(r.entry, r["rank"], r.pos, r.to_aa, r.delta) for r in U.scan_best(df_seq, features, SCALES, n, "delta").collect()} == want


def test_summary_of_a_scan_without_its_rows(spark, df_seq):
    features, _ = _scanned(spark, df_seq)
    told = lambda df: {(r.entry, r.region): (r.n, r.n_disruptive, round(r.frac_disruptive, 9), round(r.mean_delta, 9)) for r in df.collect()}
    for options in ({}, {"q": 0.9}, {"threshold": 0.05}):
        assert told(U.scan_disruptive(df_seq, features, SCALES, **options)) == told(U.scan_summary(U.feature_scan(df_seq, features, SCALES), **options))


def test_similar_windows_go(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ACDE") for _ in range(9))
    windows, test = [word() for _ in range(400)], [word() for _ in range(20)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(windows)], "center long, window string")
    got = {r.center for r in W.drop_similar(df, spark.createDataFrame([(t,) for t in test], "window string"), 9, 0.5).collect()}
    assert got == {i for i, w in enumerate(windows) if max(sum(a == b for a, b in zip(w, t, strict=True)) for t in test) / 9 <= 0.5} and 0 < len(got) < 400


def test_other_letters_of_windows_are_compared_too(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("AC-é") for _ in range(9))
    windows, test = [word() for _ in range(300)] + ["AC", None], [word() for _ in range(3)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(windows)], "center long, window string")
    got = {r.center for r in W.drop_similar(df, spark.createDataFrame([(t,) for t in test], "window string"), 9, 0.5).collect()}
    like = lambda w: len(w or "") == 9 and max(sum(a == b for a, b in zip(w, t, strict=True)) for t in test) / 9 > 0.5
    assert got == {i for i, w in enumerate(windows) if not like(w)} and 10 < len(got) < 302


def test_windows_of_sequences_unlike_test_windows(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACDE") for _ in range(60)), []) for i in range(12)]
    df = spark.createDataFrame(rows, "entry long, sequence string, pos array<int>")
    test = spark.createDataFrame([("ACDEACDEA",), ("DDDDDCCCC",)], "window string")
    told = lambda d: sorted((r.entry, r.center, r.window) for r in d.collect())
    got = told(W.explode_unlike(df, test, 9, 0.5))
    like = lambda w: max(sum(a == b for a, b in zip(w, t, strict=True)) for t in ("ACDEACDEA", "DDDDDCCCC")) > 4
    assert got == [(e, c + 5, s[c : c + 9]) for e, s, _ in rows for c in range(52) if not like(s[c : c + 9])] and 0 < len(got) < 12 * 52
    plan = W.explode_unlike(df, test, 9, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_draws_are_those_of_all_centres(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("AWH") for _ in range(rng.randint(0, 90)))) for i in range(40)] + [(40, "")]
    df = W.motif_positions(spark.createDataFrame(rows, "entry long, sequence string"), "WH")
    assert {r.entry: r.pos for r in df.collect()} == {e: [i + 1 for i in range(len(s)) if s[i : i + 2] == "WH"] for e, s in rows}
    band = {"min_distance": 3, "max_distance": 20}
    told = lambda d: [tuple(r) for r in d.select("entry", "center", "distance", "window").collect()]
    for n in (5, 70, 100_000):
        assert told(W.draw_per_protein(df, 9, n, 7, **band)) == told(W.sample_per_protein(W.explode_centers(df, 9, **band), n, 7))
        assert told(W.draw_uniform(df, 9, n, 7)) == told(W.sample_uniform(W.explode_centers(df, 9), n, 7))


def test_centres_are_filtered_before_rows_are_made(spark):
    df = spark.createDataFrame([(1, "AWHACDEFGHIKLMNPQW" * 9, [1, 40, None]), (2, "ACD", []), (3, None, None)], "entry long, sequence string, pos array<int>")
    every = {(r.entry, r.center, r.distance, r.window) for r in W.explode_centers(df, 9).collect()}
    s = "AWHACDEFGHIKLMNPQW" * 9
    assert every == {(1, c, min(abs(c - 1), abs(c - 40)), s[c - 5 : c + 4]) for c in range(5, len(s) - 3) if c not in (1, 40)}
    pwm = [[(p * 31 + a * 17) % 11 - 5 for a in range(20)] for p in range(9)]
    best = {(r.entry, r.center) for r in W.explode_centers(df, 9, where=lambda codes: W.pwm_scores(codes, pwm) >= 5).collect()}
    assert best == {(r.entry, r.center) for r in W.explode_centers(df, 9).filter(W.pwm_score(F.col("window"), pwm) >= 5).collect()} and best


def test_parts_of_many_windows_are_numbered_alike(spark):
    df = spark.range(0, 60_000, 1, 7).select((F.col("id") * 7919 % 60_000).alias("entry")).withColumn("window", F.col("entry").cast("string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # large tables have more than one range
    try:
        got = P.parts_of_windows({"tmd": df, "jmd_c": df.filter("entry % 3 = 0")}, "entry").select("entry", "tmd", "jmd_c").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r) for r in got} == {(f"REF{i}", str(i), str(3 * i)) for i in range(20_000)} and len(got) == 20_000


def test_kmers_are_counted_where_rows_are_read(spark):
    from collections import Counter

    from seqloom.operators import composition as K

    rng = random.Random(6)
    texts = ["".join(rng.choice("ACé-") for _ in range(n)) for n in (0, 1, 2, 3, 50, 200)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "entry long, s string")
    for k in (1, 2, 3, 30):
        want = {(i, w, n, len(t) - k + 1) for i, t in enumerate(texts) if t for w, n in Counter(t[j : j + k] for j in range(len(t) - k + 1)).items()}
        got = K.kmer_counts(df, F.col("s"), k)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
        assert "Exchange" not in K.kmer_fractions(df, F.col("s"), k)._jdf.queryExecution().executedPlan().toString()


def test_error_matrices_are_parsed_once(spark):
    from seqloom.operators import structure as S

    texts = ['{"pae":[[1,2],[3,4]]}', '[{"predicted_aligned_error":[[1,2],[3,4]]}]', '{"pae":[[1,2],[3]]}', "no", None, "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select("k", S.error_matrix(F.col("t")).alias("m"))
    assert {r.k: r.m for r in got.collect()} == {0: [[1, 2], [3, 4]], 1: [[1, 2], [3, 4]], 2: None, 3: None, 4: None, 5: None}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_covariance_makes_no_row_for_a_letter(spark):
    from seqloom.operators import composition as K

    df = spark.createDataFrame([(1, "ACDE"), (2, "A"), (3, ""), (4, "AX")], "entry long, s string")
    v = list(range(0, 2_000_000, 100_000))
    out = K.auto_covariance(df, F.col("s"), {"x": v}, (1, 2))
    got = {(r.entry, r.lag): r.acc for r in out.collect()}
    mean = lambda lag: sum((i - 1.5) * (i + lag - 1.5) for i in range(4 - lag)) / (4 - lag)
    assert math.isclose(got[1, 1], mean(1), abs_tol=1e-6) and math.isclose(got[1, 2], mean(2), abs_tol=1e-6) and len(got) == 8
    assert all(got[e, lag] is None for e in (2, 3, 4) for lag in (1, 2))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_windows_of_all_rows_are_counted_together(spark):
    from seqloom.operators import composition as K

    df = spark.createDataFrame([(s,) for s in ("ACDACD", "ACD", "", None)], "s string").coalesce(1)
    got = K.kmer_counts(df, F.col("s"), 3, (), together=True).groupBy("kmer").agg(F.sum("n").alias("n"))
    assert {(r.kmer, r.n) for r in got.collect()} == {("ACD", 3), ("CDA", 1), ("DAC", 1)}


def test_even_windows_are_cut_in_batches(spark):
    rows = [(1, "ACDEFGHIKLMN", [1, 1, 0, 1, None, 1, 1, None, 0, 1]), (2, "ACDé" * 3, [1] * 12), (3, "ACD", [1, 1, 1]), (4, None, None), (5, "ACDEFGHIK", None)]
    out = P.even_windows(spark.createDataFrame(rows, "entry long, sequence string, labels array<int>"), 8)

    def both(labels, i):
        a, b = ((labels[k] if labels and k < len(labels) else None) for k in (i, i - 1))
        return 0 if 0 in (a, b) else None if None in (a, b) else 1

    want = {(f"{e}_{i}|{i + 1}", s[i - 4 : i + 4], both(labels, i)) for e, s, labels in rows if s for i in range(4, len(s) - 3)}
    assert {tuple(r) for r in out.collect()} == want and len(want) > 10
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_detection_and_precision_as_defined(spark):
    nan = float("nan")
    rows = [(1, p, s, t) for p, (s, t) in enumerate([(0.9, 1), (0.1, 0), (0.8, 0), (nan, 1), (0.2, 0), (None, 0)])] + [(2, p, s, t) for p, (s, t) in enumerate([(0.7, 0), (0.6, 1), (0.1, 0)])] + [(3, 0, 0.3, 0)]
    df = spark.createDataFrame(rows, "k long, pos long, score double, truth int")
    d = M.detection(df, "score", "truth").first()
    assert (d.tp, d.fp, d.fn, d.tn) == (2, 2, 1, 3) and d.recall == 2 / 3 and d.precision == 0.5
    near = M.detection(df, "score", "truth", by="k", pos="pos", tolerance=1).first()
    assert (near.tp, near.fp, near.fn, near.tn) == (3, 1, 0, 4)
    empty = M.detection(df.filter("k = 3"), "score", "truth").first()
    assert empty.recall is None and empty.precision is None and empty.f1 is None and empty.mcc is None
    ap = {r.k: r.ap for r in M.average_precision(df, "k", "score", "truth", ["pos"]).collect()}
    assert ap == {1: 0.5, 2: 0.5, 3: None}
    ap = {r.k: r.ap for r in M.average_precision(df, "k", "score", "truth", ["pos"], tolerance=1).collect()}
    assert ap[1] == (1 + 1) / 2 and ap[2] == 1.0 and ap[3] is None


def test_smoothing_fills_what_is_missing(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 3.0, float("nan"), None, None, None, 8.0])], "k int, i int, v double")
    got = [r.smooth for r in M.smooth(df, "k", ["i"], "v", window=1).orderBy("i").collect()]
    assert got == [1.0, 2.0, 3.0, 3.0, None, None, 8.0, 8.0]
    soft = [r.smooth for r in M.smooth(df, "k", ["i"], "v", window=1, method="gaussian", sigma=1.0, keep_peaks=False).orderBy("i").collect()]
    assert soft[1] == 2.0 and soft[0] == 1.0


def test_redundancy_looks_inside_kept_features_only():
    assert S.redundant({1, 2}, set(range(1, 11)), 0.9) and not S.redundant(set(range(1, 11)), {1, 2}, 0.9)


def test_clusters_merge_and_are_judged(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(2, 12))
    x = np.concatenate([base[0] + 0.1 * rng.normal(size=(6, 12)), base[1] + 0.1 * rng.normal(size=(5, 12)), base[0][None] * 2])
    assert C.merge_clusters(x, [7] * 6 + [3] * 5 + [9], 5, 0.5) == [0] * 6 + [1] * 5 + [0]
    df = spark.createDataFrame([(i, [float(a) for a in v], int(i >= 6)) for i, v in enumerate(x[:11])], "id long, v array<double>, c int")
    far = np.sqrt(((x[:11, None] - x[None, :11]) ** 2).sum(-1))
    lab = np.array([0] * 6 + [1] * 5)
    s = []
    for i in range(11):
        a, b = far[i][(lab == lab[i]) & (np.arange(11) != i)].mean(), far[i][lab != lab[i]].mean()
        s.append((b - a) / max(a, b))
    for block in (3, 2048):
        assert math.isclose(C.silhouette(df, "id", "c", "v", block).first().sc, np.mean(s), rel_tol=1e-6)
    reps = C.representatives(df, "id", "v", 12, 2).collect()
    assert sum(r.is_representative for r in reps) == 2 and all(r.dist_to_rep == 0 for r in reps if r.is_representative)


def test_distances_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    for metric, f in (("euclidean", lambda a, b: np.linalg.norm(a - b)), ("manhattan", lambda a, b: np.abs(a - b).sum()), ("cosine", lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))):
        got = {r.id: r.distance for r in M.mean_distance_to(df.filter("id >= 10"), df.filter("id < 10"), "id", "v", metric, block=4).collect()}
        assert all(math.isclose(got[i], np.mean([f(x[i], x[j]) for j in range(10)]), rel_tol=1e-9) for i in range(10, 30))


def test_motif_p_values_are_those_of_all_words():
    pwm = [[(p * 3 + a) % 5 - 2 for a in range(20)] for p in range(2)]
    scores = [a + b for a in pwm[0] for b in pwm[1]]
    for s, p in C.motif_p_values(pwm).items():
        assert math.isclose(p, sum(v >= s for v in scores) / 400)


def test_greedy_walk_takes_the_best_letter():
    value = {a: i for i, a in enumerate(LETTERS)}
    score = lambda s: sum(value[a] for a in s)
    walk = C.greedy_walk("AAAA", [1, 2, 3, 4], score, {3: 1.0}, most=2)
    assert [s for s, _ in walk] == ["AAYA", "YAYA"] and walk[1][1] == 38.0


def test_samples_stay_unlike_each_other(spark):
    rng = random.Random(3)
    rows = [(i, 5, "".join(rng.choice("ACDE") for _ in range(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "entry long, center int, window string")
    got = [r.window for r in C.draw_until(df, 10, 9, F.md5(F.col("entry").cast("string")), max_within=0.4).collect()]
    assert len(got) == 10 and all(sum(a == b for a, b in zip(u, v, strict=True)) / 9 <= 0.4 for k, u in enumerate(got) for v in got[:k])
    arms = C.benchmark_set({"a": df.limit(2), "b": df.limit(3).withColumn("score", F.lit(1.0))})
    assert arms.groupBy("arm").count().count() == 2 and arms.filter("arm = 'a' AND score IS NULL").count() == 2


def test_tagged_atoms_in_any_order_of_columns(spark):
    text = "data_x\nloop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.Cartn_x\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n_atom_site.occupancy\n_atom_site.B_iso_or_equiv\nATOM 1 1.5 CA ALA A 7 2.5 -3.0 1.00 88.1\nATOM 2 0.0 CA GLY B 1 0 0 1.00 20\nATOM 3 9.0 CA GLY A 8 0 0 1.00 40\nHETATM 4 0 O HOH A 9 0 0 1.00 1\n#\n"
    atoms = Z.cif_atoms(spark.createDataFrame([("e", text)], "entry string, t string"), "entry", "t")
    assert [(r.serial, r.x, r.number, r.b_factor) for r in atoms.orderBy("serial").collect()][:2] == [(1, 1.5, 7, 88.1), (2, 0.0, 1, 20.0)]
    assert [(r.number, r.b_factor) for r in Z.residues_of_chain(atoms).orderBy("number").collect()] == [(7, 88.1), (8, 40.0)]


def test_streams_lie_over_the_sequence(spark):
    df = spark.createDataFrame([("ACDEF", [2, 4], [10.0, 20.0])], "s string, seen array<int>, v array<double>")
    row = df.select(Z.align_to_sequence(F.col("v"), F.col("seen"), F.col("s"), F.lit(-1.0)).alias("a"), Z.angle_features(F.array(F.lit(90.0), F.lit(360.0))).alias("g")).first()
    assert row.a == [-1.0, 10.0, -1.0, 20.0, -1.0] and row.g[1] == [0.0, 0.0] and math.isclose(row.g[0][0], 1.0)
    with pytest.raises(ValueError):
        Z.routed(spark, ["nothing"], {})


def test_columns_of_a_feature_table(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "own int, positions int, p_val_fdr_bh int, feature int, p_val_ttest_indep int")
    assert R.sort_columns(df).columns == ["feature", "p_val_ttest_indep", "p_val_fdr_bh", "positions", "own"]
    kept = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "feature string, selection_frequency double")
    assert [r.feature for r in R.select_features(kept, "frequency", 0.4).collect()] == ["a"]


def test_simplification_swaps_only_for_better_graded_scales(spark, df_seq):
    from seqloom.operators import simplify as Y

    base = scale_values(1)
    scales = {"A": base, "B": [v + 100 for v in base], "C": [100_000 - v for v in base], "D": scale_values(2)}
    grade = {"A": 5, "B": 2, "C": 1, "D": 0}
    assert [c[0] for c in Y.candidates("A", scales, grade, 0.9)] == ["C", "B"] and Y.candidates("D", scales, grade, 0.9) == []
    splits = segments(1, 2)
    features = ["TMD-Segment(1,1)-A", "TMD-Segment(2,2)-D"]
    score = lambda fs: sum(f.endswith("B") for f in fs) - sum(f.endswith("C") for f in fs)
    assert Y.greedy(features, scales, grade, score, 0.9)[0] == ["TMD-Segment(1,1)-B", "TMD-Segment(2,2)-D"]
    parts = P.get_parts(df_seq, ("tmd",), keep=("entry", "label"))
    frame = spark.createDataFrame([(f,) for f in features], "feature string")
    got = {r.feature: r.swapped_from for r in Y.swap_all(frame, parts, ("tmd",), splits, scales, grade, 0.9, max_std=1.0).collect()}
    assert got == {"TMD-Segment(1,1)-C": "TMD-Segment(1,1)-A", "TMD-Segment(2,2)-D": None}
    assert {r.feature for r in Y.swap_all(frame, parts, ("tmd",), splits, scales, grade, 0.9, max_std=1.0, drop=True).collect()} == {"TMD-Segment(1,1)-C"}
    two = ["TMD-Segment(1,1)-A", "TMD-Segment(1,2)-B", "TMD-Segment(2,2)-B"]
    assert Y.consolidate(two, {"A": "x", "B": "y", "C": "z", "D": "w"}, scales, grade, lambda fs: 1.0, 0.9) == ["TMD-Segment(1,1)-B", "TMD-Segment(1,2)-B", "TMD-Segment(2,2)-B"]


def test_discovery_fits_and_transforms(spark, df_seq):
    from seqloom.operators import pipelines as L
    from seqloom.operators.simplify import centroid_accuracy

    marked = df_seq.withColumn("sequence", F.when(F.col("label") == 1, F.regexp_replace("sequence", "[ACDEFG]", "W")).otherwise(F.col("sequence")))
    d = L.Discovery(("tmd",), segments(1, 2), SCALES, scale_metadata(spark, 3), 3, 9, 1.0).fit(marked)
    wide = d.transform(marked)
    assert wide.columns == ["entry", *[f"f{k + 1}" for k in range(len(d.features))]] and wide.count() == 42 and d.features
    values = L.feature_values_of(P.get_parts(marked, ("tmd",), keep=("entry", "label")), ("tmd",), segments(1, 2), SCALES, d.features)
    assert centroid_accuracy(values) > 0.9
    assert L.find_features(marked, {"one": (("tmd",), segments(1, 1)), "two": (("tmd",), segments(1, 2))}, SCALES, scale_metadata(spark, 3), 2, 6).count() >= 1


def test_options_provenance_and_html(spark):
    from seqloom import session

    o = session.Options()
    with pytest.raises(ValueError):
        o["ext_len"] = -1
    with pytest.raises(KeyError):
        o["nothing"] = 1
    assert o.choose("ext_len", 3) == 3
    o["ext_len"] = 2
    assert o.choose("ext_len", 3) == 2 and len(o) == len(list(o))
    df = spark.createDataFrame([(1, "<b>"), (2, "x" * 50)], "a int, b string")
    one, two = session.content_hash(df).first(), session.content_hash(df.orderBy(F.desc("a")).repartition(3)).first()
    assert one == two and session.content_hash(df.unionByName(df)).first().hash != one.hash and session.provenance(df)["n_rows"] == 2
    page = session.html_table(df)
    assert "&lt;b&gt;" in page and "x" * 29 + "…" in page


def test_statistics_of_a_stream_equal_those_of_its_rows(spark, tmp_path):
    from seqloom.streaming import moments as Q

    rng = random.Random(4)
    rows = [(f"f{rng.randrange(2)}", rng.randrange(2), rng.randrange(1000) / 1000, f"2024-01-01 {h:02d}:{rng.randrange(60):02d}:00") for h in range(8) for _ in range(30)]
    df = spark.createDataFrame(rows, "feature string, label int, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for h in range(8):
        df.filter(F.hour("ts") == h).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    closing = spark.createDataFrame([("f0", 9, 0.0, "2024-01-03 00:00:00")], "feature string, label int, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    closing.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        Q.keep_moments(Q.windowed_moments(Q.read_values(spark, str(tmp_path / "in")), "2 hours", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.feature: (r.n_test, r.n_ref, r.mean_dif, r.std_test) for r in Q.statistics_of(spark, str(tmp_path / "out")).collect()}
    want = {r.feature: (r.n_test, r.n_ref, r.mean_dif, r.std_test) for r in T.finalize_moments(T.group_moments(df)).collect()}
    assert got == want
    later = Q.statistics_of(spark, str(tmp_path / "out"), "2024-01-01 04:00:00")
    assert later.agg(F.sum("n_test") + F.sum("n_ref")).first()[0] == 120


def test_front_of_three_objectives(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(12), rng.randrange(12), rng.randrange(12)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int").repartition(5)
    beats = lambda x, y: all(p >= q for p, q in zip(x[1:], y[1:], strict=True)) and x[1:] != y[1:]
    want = {y[0] for y in rows if not any(beats(x, y) for x in rows)}
    assert {r.id for r in U.pareto_front(df, "id", ["a", "b", "c"]).collect()} == want
    two = {y[0] for y in rows if not any(x[1] >= y[1] and x[2] >= y[2] and x[1:3] != y[1:3] for x in rows)}
    assert {r.id for r in U.pareto_front(df, "id", ["a", "b"]).collect()} == two


def test_contributions_add_up_to_the_logit(spark):
    from seqloom.operators import explain as E

    rows = [(i, f, float((i * k) % 5)) for i in range(6) for k, f in enumerate("abc", 1)]
    w = {"a": 2.0, "b": -1.0, "c": 0.5}
    got = E.linear_contributions(spark.createDataFrame(rows, "entry int, feature string, value double"), w).groupBy("entry").agg(F.sum("value").alias("s"))
    logit = {i: sum(w[f] * v for j, f, v in rows if j == i) for i in range(6)}
    mean = sum(logit.values()) / 6
    assert all(math.isclose(r.s, logit[r.entry] - mean, abs_tol=1e-9) for r in got.collect())


def test_generated_windows(spark):
    from seqloom.operators import explain as E

    assert {a for r in E.synthetic_windows(spark, 200, 6, "charged").collect() for a in r.window} == set("DEKR")
    freq = E.position_frequencies(spark.createDataFrame([("AC",), ("AD",), ("AD",)], "window string"))
    made = [r.window for r in E.synthetic_windows(spark, 300, 2, "position", freq).collect()]
    assert {w[0] for w in made} == {"A"} and 0.5 < sum(w[1] == "D" for w in made) / 300 < 0.8
    both = E.scrambled(spark.createDataFrame([("ACDEFGHIK",)], "window string")).first()
    assert sorted(both.scrambled) == sorted("ACDEFGHIK") and both.scrambled != both.window


def test_redundant_sequences_join_the_longest(spark):
    from seqloom.operators import explain as E

    rng = random.Random(5)
    seqs = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60, 90))) for _ in range(12)]
    for k in range(30):
        s = list(rng.choice(seqs[:12]))
        for _ in range(rng.randrange(2)):
            s[rng.randrange(len(s))] = rng.choice(LETTERS)
        seqs.append("".join(s)[: len(s) - rng.randrange(6)])
    seqs.append("ACD")
    words = [{s[i : i + 5] for i in range(max(len(s) - 4, 1))} for s in seqs]
    order = sorted(range(len(seqs)), key=lambda i: (-len(seqs[i]), i))
    want: dict = {}
    for at, e in enumerate(order):
        leaders = [x for x in order[:at] if want[x] == x and len(words[e] & words[x]) >= 0.8 * len(words[e])]
        want[e] = leaders[0] if leaders else e
    df = spark.createDataFrame(list(enumerate(seqs)), "entry long, sequence string")
    got = {r.entry: r.representative for r in E.identity_clusters(df, "entry", "sequence", 0.8, 5).collect()}
    assert got == want and len(set(want.values())) < 25


def test_projection(spark):
    from seqloom.operators import explain as E

    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(5, 4)), rng.normal(size=(4, 2))
    got = {r.id: r.coordinates for r in E.project(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", c).collect()}
    want = (x - x.mean(axis=1, keepdims=True)) @ c
    assert all(np.allclose(got[i], want[i]) for i in range(5))
