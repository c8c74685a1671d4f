"""Shared helpers of the pipeline operators: tables, checkpoints, vectorised word handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_BYTES = b" \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: All ASCII but letters and digits.
NOT_LETTERS = np.zeros(256, dtype=bool)
NOT_LETTERS[:128] = [not chr(c).isalnum() for c in range(128)]

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_HASH_BYTES = 1 << 18


#: Arrow batches to Python workers: few rows, and few bytes where rows are long.
BATCH_ROWS, BATCH_BYTES = "2000", str(8 << 20)


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches of texts small, in the JVM's buffers as in the workers; sizes set by the user stay."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) in (None, "10000", "9223372036854775807", "64MB", "67108864"):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where it is unset and all runs in one process (tests)."""
    bounded_batches(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/seqloom-checkpoints")
    return folder or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written in the shared folder: compressed, and read again by columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores in front of it until no column is called so (letter case doesn't count)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, *new: str) -> DataFrame:
    """``df`` with columns that are called like ``new`` ones kept under ``<name>_input`` (with underscores in front, if that is taken too)."""
    for name in new:
        for c in [c for c in df.columns if c.lower() == name.lower()]:
            df = df.withColumnRenamed(c, free_name(f"{c}_input", [*df.columns, *new]))
    return df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def batch_slices(sizes: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes, one row at least."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + target, side="right")))
        yield at, stop
        at = stop


def text_buffer(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one more at the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return (LOWER[raw] if lower else raw), at - at[0]


def words_of(raw: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts in ``raw``, and the number of the first word of each text (one more at the
    end). ``between``: which bytes stand between words."""
    word = ~between[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[at] = True
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = False
        before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        after[-1] = False
        after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        _TABLES["up"], _TABLES["down"] = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    return _TABLES["up"], _TABLES["down"]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, scrambled; temporary memory follows the longest word or 256 KB."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _HASH_BYTES, side="right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        up, down = _power_tables(max(_HASH_BYTES, hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes, whatever text they come from."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)


# Documents by id without shuffling the texts of all

BLOOM_BITS = 1 << 26


def bloom_bits(n: int, most: int = 1 << 28) -> int:
    """16 to 32 bits an id, from 2 MB to 32 MB (or ``most`` bits); a filter of more ids lets more rows pass, which the join after it sorts out."""
    return min(1 << max(16 * n, 1 << 23).bit_length(), most)


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    x = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([x & np.uint64(bits - 1), (x >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def bloom_of(ids: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of fixed size (bits / 8 bytes) over the longs in the first column of ``ids``; it lets more pass as it fills."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bloom_places(batch.column(0).to_numpy(zero_copy_only=False), bits))
            words, where = np.unique(at >> 6, return_inverse=True)
            masks = np.zeros(len(words), dtype=np.uint64)
            np.bitwise_or.at(masks, where, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.int64()), "bits": pa.array(masks.view(np.int64), pa.int64())})

    name = ids.columns[0]
    rows = ids.filter(F.col(name).isNotNull()).mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def bloom_has(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _bloom_places(ids, len(bloom) << 6)
    hit = ((bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return hit[: len(ids)] & hit[len(ids) :]


def maybe_in(df: DataFrame, key: str, bloom: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose long ``key`` is in the filter, and a few others; its size in memory is fixed."""
    sent = df.sparkSession.sparkContext.broadcast(bloom)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom_has(sent.value, batch.column(key).fill_null(0).to_numpy(zero_copy_only=False))))

    return df.mapInArrow(keep, df.schema)
