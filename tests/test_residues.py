"""Residue windows, annotations, domains, centres and fronts on hand-checkable cases."""

import math

from pyspark.sql import functions as F

from seqloom.functions.splits import segments
from seqloom.operators import residues as R


def test_windows_carry_the_label_of_their_middle(spark):
    df = spark.createDataFrame([("a", "ACDEF", "0,1,2,3,4"), ("b", "AC", "0,1"), ("c", "", "")], "entry string, sequence string, labels string")
    got = {tuple(r) for r in R.labelled_windows(df, 3).collect()}
    assert got == {("a", 2, "ACD", "1"), ("a", 3, "CDE", "2"), ("a", 4, "DEF", "3")}


def test_the_last_annotation_holds(spark):
    df = spark.createDataFrame([("a", 1, 1, 3, 0.1), ("a", 2, 3, 4, 0.2), ("a", 3, 5, 4, 0.9)], "entry string, row int, start int, stop int, score double")
    assert {(r.pos, r.score) for r in R.annotate(df, "entry", "row", "score").collect()} == {(1, 0.1), (2, 0.1), (3, 0.2), (4, 0.2)}


def test_the_first_domain_holds(spark):
    df = spark.createDataFrame([("a", 1, 1, 3), ("a", 2, 3, 4), ("a", 3, 9, 9)], "entry string, no int, start int, stop int")
    got = {r.pos: (r.boundary, r.relative, r.size, r.n_domains) for r in R.domain_values(df, "entry", "no").collect()}
    assert got == {1: (1, 0.0, 0.015, 0.3), 2: (0, 0.5, 0.015, 0.3), 3: (1, 1.0, 0.015, 0.3), 4: (1, 1.0, 0.01, 0.3), 9: (1, 0.0, 0.005, 0.3)}


def test_position_means(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 5.0])], "id int, v array<double>")
    got = {r.split: r.value for r in R.position_means(df, "id", "v", 4, segments(1, 2)).collect()}
    assert got == {"Segment(1,1)": 2.75, "Segment(1,2)": 1.5, "Segment(2,2)": 4.0}


def test_centres_correlate(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (0, [3.0, 4.0, 5.0]), (1, [3.0, 2.0, 1.0])], "label int, v array<double>")
    pair = R.center_correlations(df, "label", "v", 3).first()
    assert (pair.a, pair.b) == (0, 1) and math.isclose(pair.correlation, -1.0)
    assert all(math.isclose(r.least, 1.0) for r in R.least_center_correlation(df, "label", "v", 3).collect())


def test_spread_counts_copies_and_small_fronts(spark):
    df = spark.createDataFrame([(0.0, 4.0), (2.0, 0.0), (2.0, 0.0)], "x double, y double")
    assert math.isclose(R.front_spread(df, ["x", "y"]).first().spread, 2 * math.sqrt(2) / 3)
    assert R.front_spread(df.limit(1), ["x", "y"]).first().spread == 0.0
    assert R.front_spread(df.filter(F.lit(False)), ["x", "y"]).first().spread == 0.0
