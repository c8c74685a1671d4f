"""Rendezvous sharding: every record goes to the shard with the highest score for its key.

A shard's score for a key is ``weight / -ln(u)``, with u in (0, 1) from a hash of key and shard number. Only
the key, the shard numbers and the weights decide, so a further shard takes records only into itself and moves the
expected share of records and no others. Equal scores (possible with tiny hashes only) go to the smaller shard number.

All of it is expressions in the plan: one pass computes the shards, one aggregate of bounded size (shards x slices)
gives the offsets of the slots, and one window numbers the rows of a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import set_aside, table, text_or_empty

SHARDS = 24
#: Slices of a shard whose rows are numbered together; raise it so that rows / shards / SLICES fits a task.
SLICES = 64


def _unit(key: Column, shard: int) -> Column:
    """52 bits of MD5 as a number strictly between 0 and 1."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard number of a key (null keys act as one key of their own); weights must be above 0."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a weight above 0")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    best = F.greatest(*[F.struct((F.lit(float(w)) / -F.log(_unit(text, s))).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]) if len(weights) > 1 else F.struct(F.lit(0).alias("shard"))
    return (-best["shard"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with a shard number; rows are kept as they are, also repeated ones, those with a null key, and texts of any length; an empty table gives no rows.
    Columns may have any name; one that is called like ``out`` already is kept as ``<out>_input``."""
    return set_aside(df, out).withColumn(out, rendezvous(F.col(key), weights))


def number_slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot", slices: int = SLICES) -> DataFrame:
    """Gapless numbers from 0 in each shard. No task holds a whole shard: rows are numbered in slices by a hash of
    ``order``, and a table of at most shards x slices counts gives each slice its first number. Rows equal in all of ``order``
    share a slice, so repeated rows get numbers of their own in any order."""
    sliced = df.withColumn("_slice", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in order])), 1, 8), 16, 10).cast("long"), F.lit(slices)))
    counts = sliced.groupBy(shard, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(shard).alias("_shard"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy(shard, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_own", F.row_number().over(own) - 1)
    joined = numbered.join(F.broadcast(first), (F.col(shard) == F.col("_shard")) & (F.col("_slice") == F.col("_of")))
    return joined.withColumn(out, (F.col("_first") + F.col("_own")).cast("long")).drop("_slice", "_shard", "_of", "_first", "_own")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 equal shards under the law ``key``.

    Empty and null texts have size 8 and the CRC of no bytes; an empty table gives no rows; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("_text"))
    rows = docs.select(
        "doc_id",
        (F.octet_length("_text") + 8).cast("long").alias("size"),
        F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * SHARDS).alias("shard"),
        rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )
    numbered = number_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
