"""Hand-checkable cases of parts, splits, encodings and statistics."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import parts as P
from seqloom.functions.splits import Split, patterns, periodic_patterns, segments
from seqloom.operators import composition as C
from seqloom.operators import labels as L
from seqloom.operators import metrics as X
from seqloom.operators import mutation as M
from seqloom.operators import select as S
from seqloom.operators import stats as T
from seqloom.operators import windows as W


def one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expr).first()[0]


@pytest.mark.parametrize(("split", "text", "want"), [
    (Split("Segment", (1, 2)), "ABCDE", "AB"), (Split("Segment", (2, 2)), "ABCDE", "CDE"), (Split("Segment", (2, 3)), "ABCDE", "BC"),
    (Split("Pattern", ("C", (1, 3))), "ABCDE", "EC"), (Split("PeriodicPattern", ("N", 3, 4, 1)), "ABCDEFGHIJKL", "ADHK"), (Split("PeriodicPattern", ("C", 3, 4, 2)), "", ""),
])
def test_splits(spark, split, text, want):
    assert one(spark, split.letters(F.col("s")), s=text) == want


def test_split_positions_agree_with_letters(spark):
    for split in [*segments(1, 4), *patterns()[:5], *periodic_patterns()[:6]]:
        letters = "ACDEFGHIKLMNPQRSTVWY"
        assert sorted(one(spark, split.letters(F.col("s")), s=letters)) == sorted(letters[p - 1] for p in split.positions(20))


def test_parts(spark):
    df = spark.createDataFrame([(1, "ABCDEF", 4, 5), (2, "ABCDEFGHIJ", 3, 7)], "entry int, sequence string, tmd_start int, tmd_stop int")
    got = {r.entry: r for r in P.get_parts(df, P.ALL_PARTS, 5, 5).collect()}
    assert got[1].jmd_n == "--ABC" and got[1].tmd == "DE" and got[1].jmd_c == "F----"
    assert got[2].tmd_n == "CD" and got[2].tmd_c == "EFG" and got[2].tmd_jmd == "---ABCDEFGHIJ--"
    assert P.get_parts(df, ("jmd_n",), 2, 2, drop_gaps=True).count() == 2


def test_windows(spark):
    assert one(spark, P.sliding_windows(F.col("s"), 3), s="ABCDE") == ["ABC", "BCD", "CDE"] and one(spark, P.sliding_windows(F.col("s"), 3), s="AB") == []
    assert P.window_offsets(9) == (4, 5) and P.window_offsets(4) == (1, 3)
    assert one(spark, P.window_at(F.col("s"), F.lit(4), 4), s="ABCDE") == "DE--"
    assert one(spark, P.pad(F.col("s"), 4, at="N"), s="AB") == "--AB" and one(spark, P.pad(F.col("s"), 1), s="AB") == "AB"


def test_composition(spark):
    df = spark.createDataFrame([(1, "A-CD"), (2, ""), (3, "KKK")], "entry int, s string")
    free = df.select("entry", C.gap_free(("s",)).alias("s"))
    assert {(r.kmer, r.fraction) for r in C.kmer_fractions(free, F.col("s"), 2).filter("entry = 1").collect()} == {("AC", 0.5), ("CD", 0.5)}
    assert C.letter_fractions(free, F.col("s")).filter("entry = 2 AND fraction IS NOT NULL").count() == 0
    acc = C.auto_covariance(free, F.col("s"), {"x": list(range(20))}, (1,)).collect()
    assert {r.entry: r.acc for r in acc}[3] == 0.0 and {r.entry: r.acc for r in acc}[2] is None
    assert one(spark, C.integer_codes(F.col("s")), s="AY-") == [1, 20, 0]


def test_statistics(spark):
    rng = random.Random(0)
    rows = [(f"f{k}", rng.randrange(2), round(rng.choice([0.1, 0.2, 0.25, 0.7]) + k / 10, 5)) for k in range(3) for _ in range(60)]
    values = spark.createDataFrame(rows, "feature string, label int, value double")
    got = {r.feature: r for r in T.mann_whitney(T.adjusted_auc(T.rank_sums(values))).collect()}
    moments = {r.feature: r for r in T.finalize_moments(T.group_moments(values)).collect()}
    for f in got:
        a, b = ([v for g, y, v in rows if g == f and y == label] for label in (1, 0))
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        assert abs(got[f].auc - (u / len(a) / len(b) - 0.5)) <= 0.0005 + 1e-9 and got[f].u == min(u, len(a) * len(b) - u)
        assert abs(moments[f].mean_dif - (np.mean(a) - np.mean(b))) < 1e-6 and abs(moments[f].std_test - np.std(a)) < 1e-6
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p_value double")
    assert [r.p_fdr for r in T.benjamini_hochberg(p).orderBy("i").collect()] == [0.03, 0.04, 0.04, None]


def test_redundancy(spark):
    rows = [("a", "s1", "c", [1, 2, 3], 0.4, 0.2), ("b", "s1", "c", [1, 2, 3, 4], 0.3, 0.2), ("c", "s2", "c", [1, 2], 0.2, 0.2), ("d", "s1", "e", [1, 2, 3], 0.1, 0.2), ("f", "s1", "c", [9], 0.1, 0.1)]
    df = spark.createDataFrame(rows, "feature string, scale_id string, category string, positions array<int>, abs_auc double, abs_mean_dif double")
    kept = S.greedy_redundancy(df, {"s1": [1, 2, 3], "s2": [3, 2, 1]}, 10).orderBy("rank").collect()
    assert [r.feature for r in kept] == ["a", "c", "d", "f"]
    assert S.part_positions("tmd", Split("Segment", (1, 2))) == list(range(11, 21))


def test_labels(spark):
    assert [one(spark, L.score_band(F.col("x"), (50, 80)), x=x) for x in (50.0, 79.9, 80.0, 10.0)] == [1, 1, 2, 0]
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, x double")
    assert L.by_quantile(df, "x", 0.5).agg(F.sum("y")).first()[0] == 5
    assert L.one_vs_one(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", "abc").count() == 6


def test_similarity_filter_is_exact(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ACD") for _ in range(9))
    windows, test = [word() for _ in range(80)], [word() for _ in range(12)]
    for most in (0.0, 0.5, 0.7, 1.0):
        want = sorted(w for w in windows if not any(sum(a == b for a, b in zip(w, t, strict=True)) / 9 > most for t in test))
        got = W.drop_similar(spark.createDataFrame([(w,) for w in windows], "window string"), spark.createDataFrame([(t,) for t in test], "window string"), 9, most)
        assert sorted(r.window for r in got.collect()) == want
    assert W.greedy_unlike(["AAA", "AAC", "CCC"], 0.5) == [0, 2]


def test_sampling(spark):
    df = spark.createDataFrame([(1, "A" * 30, [15]), (2, "C" * 12, [])], "entry int, sequence string, pos array<int>")
    rows = W.explode_centers(df, 9, min_distance=3, max_distance=5)
    assert sorted(r.center for r in rows.filter("entry = 1").collect()) == [10, 11, 12, 18, 19, 20]
    assert sorted(r.center for r in rows.filter("entry = 2").collect()) == [5, 6, 7, 8]
    assert W.segments_output(W.sample_per_protein(rows, 3), "same", "neg", 0, 9).count() == 3
    lcs = W.common_subsequence(spark.createDataFrame([("ABCBDAB", "BDCABA"), ("", ""), ("A", "")], "a string, b string")).collect()
    assert [round(r.similarity, 3) for r in lcs] == [57.143, 100.0, 0.0]


def test_mutation_and_fronts(spark):
    assert one(spark, M.mutate(F.col("s"), F.lit(2), F.lit("W")), s="ABC") == "AWC"
    rng = random.Random(3)
    pts = [(i, rng.randrange(8), rng.randrange(8), rng.randrange(8)) for i in range(60)]
    df = spark.createDataFrame(pts, "k int, a int, b int, c int")
    for names in (("a", "b"), ("a", "b", "c")):
        cut = {p[0]: p[1 : 1 + len(names)] for p in pts}
        want = {k for k, p in cut.items() if not any(all(y >= x for x, y in zip(p, q, strict=True)) and q != p for q in cut.values())}
        assert {r.k for r in M.pareto_front(df, "k", list(names)).collect()} == want
    front = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double")
    assert M.hypervolume_2d(front, "x", "y").first()[0] == 3.0
    w = np.array([[1, 1], [2, 2], [2, 1], [0, 3]])
    assert M.non_dominated_ranks(w).tolist() == [2, 0, 1, 0]
    assert M.evolve("AAAA", [1, 2], [lambda s: s.count("W"), lambda s: s.count("A")], 8, 4) == M.evolve("AAAA", [1, 2], [lambda s: s.count("W"), lambda s: s.count("A")], 8, 4)


def test_metrics(spark):
    s = spark.createDataFrame([(0.9, 1), (0.1, 0), (0.8, 1), (0.2, 0)], "score double, truth int")
    d = X.detection(s, "score", "truth").first()
    assert (d.tp, d.fp, d.fn, d.tn, d.mcc) == (2, 0, 0, 2, 1.0)
    ten = spark.createDataFrame([(float(i),) for i in range(19)], "v double")
    # 19 values: the level is ceil(20 * 0.9) / 19 = 18 / 19, its position in 0..18 is 17.05, rounded up
    assert X.conformal_quantile(ten, "v", 0.1).first()[0] == 18.0 and X.conformal_quantile(ten, "v", 0.5).first()[0] == 10.0
    pts = [(i, *np.random.default_rng(i).random(3).tolist()) for i in range(80)]
    want = {a[0]: sum(a[0] != b[0] and sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)) <= 0.04 for b in pts) for a in pts}
    assert {r.k: r.contacts for r in X.contacts(spark.createDataFrame(pts, "k int, x double, y double, z double"), "k", ["x", "y", "z"], 0.2).collect()} == want


def test_sources_and_stream(spark, tmp_path):
    from seqloom.sources import annotations, fasta
    from seqloom.streaming.moments import running_moments

    df = spark.createDataFrame([("P1", "ACDE", "x"), ("P2", "", "y")], "entry string, sequence string, db string")
    fasta.write_fasta(df, str(tmp_path / "f"), infos=("db",))
    assert sorted(tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "f"), infos=("db",)).collect()) == [("P1", "ACDE", "x"), ("P2", "", "y")]
    js = '{"features":[{"type":"Site","location":{"start":{"value":3},"end":{"value":4}},"evidences":[{"evidenceCode":"E1"}]},{"type":"Chain"}]}'
    rows = annotations.record_rows(spark.createDataFrame([("P1", js)], "entry string, json string"), "entry", "json").collect()
    assert tuple(rows[0]) == ("P1", "Site", 3, 4, "E1") and rows[1].start is None
    line = "ATOM      1  CA  ALA A   5      11.104   6.134  -6.504  1.00  0.00           C"
    assert tuple(annotations.pdb_atoms(spark.createDataFrame([(line,), ("TER",)], "value string")).first()) == (1, "CA", "ALA", "A", 5, 11.104, 6.134, -6.504)
    values = spark.createDataFrame([("f", i % 2, i / 10) for i in range(10)], "feature string, label int, value double")
    values.write.parquet(str(tmp_path / "v"))
    stream = running_moments(spark.readStream.schema(values.schema).parquet(str(tmp_path / "v")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("moments").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert T.finalize_moments(spark.table("moments")).collect() == T.finalize_moments(T.group_moments(values)).collect()
