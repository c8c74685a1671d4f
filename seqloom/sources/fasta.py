"""FASTA as a source and sink: records are split by the reader, so files of any size are read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str, sep: str = "|", infos: tuple[str, ...] = ()) -> DataFrame:
    """``entry, sequence`` and further header fields by name; lines of one record are put together. Text before the first record raises when read."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    header = F.substring_index("value", "\n", 1)
    fields = F.split(header, f"\\Q{sep}\\E")
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    return rows.select(F.trim(fields[0]).alias("entry"), body.alias("sequence"), *[F.get(fields, i + 1).alias(c) for i, c in enumerate(infos)])


def fasta_lines(df: DataFrame, entry: str = "entry", sequence: str = "sequence", sep: str = "|", infos: tuple[str, ...] = ()) -> DataFrame:
    """One text column: header and sequence of each row."""
    head = F.concat(F.lit(">"), F.concat_ws(sep, F.col(entry).cast("string"), *[F.col(c).cast("string") for c in infos]))
    return df.select(F.concat(head, F.lit("\n"), F.col(sequence)).alias("value"))


def write_fasta(df: DataFrame, path: str, **names) -> None:
    fasta_lines(df, **names).write.text(path)
