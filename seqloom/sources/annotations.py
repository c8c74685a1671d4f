"""Annotation tables: user rows with defaults, JSON records, chopping strings, PDB lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "struct<features:array<struct<type:string,description:string,location:struct<start:struct<value:int>,end:struct<value:int>>,evidences:array<struct<evidenceCode:string>>>>>"


def ingest(df: DataFrame) -> DataFrame:
    """A user's table with defaults: end is start, source is user, score is 1."""
    have = set(df.columns)
    of = lambda c, d: F.coalesce(F.col(c), d) if c in have else d
    return df.select("protein_id", "feature_type", F.col("start").cast("int").alias("start"), of("end", F.col("start")).cast("int").alias("end"), of("source", F.lit("user")).alias("source"), of("score", F.lit(1.0)).alias("score"))


def record_rows(df: DataFrame, entry: str, json: str) -> DataFrame:
    """``protein_id, feature_type, start, end, evidence`` of JSON records."""
    rows = df.select(F.col(entry).alias("protein_id"), F.explode(F.from_json(json, RECORD)["features"]).alias("f"))
    return rows.select("protein_id", F.col("f.type").alias("feature_type"), F.col("f.location.start.value").alias("start"), F.col("f.location.end.value").alias("end"), F.get(F.col("f.evidences"), 0)["evidenceCode"].alias("evidence"))


def chopping(text: Column) -> Column:
    """``a-b_c-d,e-f`` as an array of domains, each an array of (start, stop)."""
    part = lambda r: F.struct(F.split(r, "-")[0].cast("int").alias("start"), F.split(r, "-")[1].cast("int").alias("stop"))
    return F.transform(F.split(text, ","), lambda d: F.transform(F.split(d, "_"), part))


def pdb_atoms(lines: DataFrame, value: str = "value") -> DataFrame:
    """Atom rows of PDB text: fixed columns of the format."""
    cut = lambda a, n: F.trim(F.substring(value, a, n))
    rows = lines.filter(F.substring(value, 1, 4) == "ATOM")
    return rows.select(cut(7, 5).cast("int").alias("serial"), cut(13, 4).alias("atom"), cut(18, 3).alias("residue"), cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("number"), *[cut(a, 8).cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))])
