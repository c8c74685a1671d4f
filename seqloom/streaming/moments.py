"""Group statistics over a stream: mergeable sums per feature and window of event time, late rows within the watermark included, kept as tables that can be merged again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import finalize_moments, group_moments

_SUMS = [f"{s}_{g}" for g in ("test", "ref") for s in ("n", "sum", "sq")]


def read_values(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of ``feature, label, value, ts`` from Parquet files as they arrive."""
    return spark.readStream.schema("feature string, label int, value double, ts timestamp").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_moments(values: DataFrame) -> DataFrame:
    """Sums of both groups per feature since the stream began (output mode complete or update); state is six numbers per feature."""
    return group_moments(values)


def windowed_moments(values: DataFrame, window: str, late: str) -> DataFrame:
    """Sums of both groups per feature and tumbling ``window``; rows later than ``late`` are not waited for. State is six numbers per feature and open window."""
    sums = group_moments(values.withWatermark("ts", late), key=[F.window("ts", window).alias("_w"), "feature"])
    return sums.select(F.col("_w.start").alias("start"), "feature", *_SUMS)


def keep_moments(moments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each closed window once; a batch that is written again after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return moments.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def statistics_of(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Mean differences and deviations of all kept windows, or those from ``since`` on: sums of sums."""
    kept = spark.read.schema("start timestamp, feature string, " + ", ".join(f"{c} long" for c in _SUMS)).option("recursiveFileLookup", "true").parquet(path)
    kept = kept if since is None else kept.filter(F.col("start") >= F.lit(since).cast("timestamp"))
    return finalize_moments(kept.groupBy("feature").agg(*[F.sum(c).alias(c) for c in _SUMS]))
