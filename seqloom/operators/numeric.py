"""Per-residue tensors: an array of vectors per sequence, sliced into parts and averaged over splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS
from ..functions.parts import letters_of
from ..functions.splits import Split


def residue_tensor(sequence: Column, scales: Mapping[str, Sequence[int]], unit: float = 100_000.0) -> Column:
    """A vector of scale values per letter; null in every dimension for an unknown letter."""
    tables = [F.array(*[F.lit(v / unit) for v in values]) for values in scales.values()]
    return F.transform(letters_of(sequence), lambda a: F.array(*[F.get(t, F.instr(F.lit(LETTERS), a) - 1) for t in tables]))


def tensor_parts(df: DataFrame, tensor: str, parts: Sequence[str], dims: int, jmd_n_len: int = 10, jmd_c_len: int = 10, keep: Sequence[str] = ("entry",)) -> DataFrame:
    """A column of vectors per part, as the part vocabulary cuts letters; flanks past the sequence are null vectors on their outer side."""
    t, start, stop = F.col(tensor), F.col("tmd_start"), F.col("tmd_stop")
    gap = F.array_repeat(F.lit(None).cast("double"), dims)
    left = F.greatest(start - jmd_n_len, F.lit(1))
    n = F.slice(t, left, F.greatest(start - left, F.lit(0)))
    c = F.slice(t, stop + 1, F.lit(jmd_c_len))
    tmd = F.slice(t, start, F.greatest(stop - start + 1, F.lit(0)))
    half = F.bround(F.size(tmd) / 2, 0).cast("int")
    pad = lambda x, size: F.array_repeat(gap, F.greatest(F.lit(size) - F.size(x), F.lit(0)))
    jmd_n, jmd_c = F.concat(pad(n, jmd_n_len), n), F.concat(c, pad(c, jmd_c_len))
    tmd_n, tmd_c = F.slice(tmd, F.lit(1), half), F.slice(tmd, half + 1, F.greatest(F.size(tmd) - half, F.lit(0)))
    made = {"tmd": tmd, "tmd_e": tmd, "tmd_n": tmd_n, "tmd_c": tmd_c, "jmd_n": jmd_n, "jmd_c": jmd_c, "tmd_jmd": F.concat(jmd_n, tmd, jmd_c), "jmd_n_tmd_n": F.concat(jmd_n, tmd_n), "tmd_c_jmd_c": F.concat(tmd_c, jmd_c)}
    return df.select(*keep, *[made[p].alias(p) for p in parts])


def _positions(split: Split, length: int) -> np.ndarray:
    at = np.asarray(split.positions(length), dtype=np.int64)
    return at[at <= length] - 1 if len(at) else at


def tensor_values(df_parts: DataFrame, parts: Sequence[str], splits: Sequence[Split], names: Sequence[str], keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``keep, feature, value``: the mean of each dimension over each split of each part, missing vectors aside, rounded half up to 5 digits; null where there are none.

    A segment is a difference of running sums, so a part is read once whatever the number of splits."""
    kinds, dims = dict(df_parts.dtypes), len(names)
    labels = [f"{p.upper()}-{s.label}-{d}" for p in parts for s in splits for d in names]

    def means(x: np.ndarray) -> np.ndarray:
        there = ~np.isnan(x)
        sums, counts = (np.concatenate([np.zeros((1, dims)), np.cumsum(v, axis=0)]) for v in (np.where(there, x, 0.0), there.astype(float)))
        out = np.full((len(splits), dims), np.nan)
        for k, split in enumerate(splits):
            if split.kind == "Segment":
                i, n = split.args
                lo, hi = int(len(x) / n * (i - 1)), int(len(x) / n * i)
                total, count = sums[hi] - sums[lo], counts[hi] - counts[lo]
            else:
                at = _positions(split, len(x))
                total, count = np.where(there[at], x[at], 0.0).sum(axis=0), there[at].sum(axis=0)
            out[k] = np.where(count > 0, total / np.maximum(count, 1), np.nan)
        return np.floor(out * 1e5 + 0.5 + 1e-7) / 1e5  # running sums are off by some 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = np.concatenate([means(np.asarray(batch.column(p)[i].values.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, dims)).reshape(-1) for p in parts])
                columns = [pa.array([batch.column(c)[i].as_py()] * len(value), batch.column(c).type) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value, mask=np.isnan(value))], names=[*keep, "_n", "value"])

    rows = df_parts.select(*keep, *parts).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_n int, value double"]))
    return rows.select(*keep, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("_n") + 1).alias("feature"), "value")


#: Letters whose vectors are held at once.
_LETTERS_AT_ONCE = 1 << 19


def _read(batches: Iterator[pa.RecordBatch], sequence: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``rows, codes, at``: slices of rows, the numbers of all their letters (20: another letter), and where each row's begin and the last one ends."""
    code = np.full(1 << 16, 20, dtype=np.int64)
    code[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(20)
    for batch in batches:
        texts, first = batch.column(sequence).to_pylist(), 0
        ends = np.cumsum([len(t or "") for t in texts])
        while first < len(texts):
            begun = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begun + _LETTERS_AT_ONCE, side="right")))
            points = np.frombuffer("".join(t or "" for t in texts[first:last]).encode("utf-32-le"), np.uint32)
            yield batch.slice(first, last - first), code[np.minimum(points, len(code) - 1)], np.concatenate([[0], ends[first:last] - begun])
            first = last


def letter_vectors(codes: np.ndarray, scales: Mapping[str, Sequence[int]]) -> np.ndarray:
    """``(letters, scales)``: values of letters in whole units, and a last column of ones for those that have any."""
    return np.array([[*v, 0] for v in [*scales.values(), [1] * 20]], dtype=np.int64).T[codes]


def residue_values(df: DataFrame, parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]], unit: float = 100_000.0, jmd_n_len: int = 10, jmd_c_len: int = 10, keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``tensor_values`` of ``tensor_parts`` of ``residue_tensor``: the tensors of ``df(keep, sequence, tmd_start, tmd_stop)`` are made where the sequences are read, so that
    no vector becomes an element of a column. Parts are ranges of positions (those outside of the sequence have no vector), and running sums are whole numbers."""
    kinds, dims = dict(df.dtypes), len(scales)
    labels = [f"{p.upper()}-{s.label}-{d}" for p in parts for s in splits for d in scales]

    def ranges(start: np.ndarray, stop: np.ndarray, sizes: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        first, last = start - 1, np.maximum(np.minimum(stop, sizes), start - 1)
        half = first + np.round((last - first) / 2).astype(np.int64)  # half to even
        left, right = first - jmd_n_len, last + jmd_c_len
        return {"tmd": (first, last), "tmd_e": (first, last), "tmd_n": (first, half), "tmd_c": (half, last), "jmd_n": (left, first), "jmd_c": (last, right), "tmd_jmd": (left, right), "jmd_n_tmd_n": (left, half), "tmd_c_jmd_c": (half, right)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, codes, at in _read(batches, "sequence"):
            x = letter_vectors(codes, scales)
            running = np.concatenate([np.zeros((1, dims + 1), np.int64), np.cumsum(x, axis=0)])
            sizes, base = np.diff(at), at[:-1]
            spans = ranges(*(rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tmd_start", "tmd_stop")), sizes)
            sums = np.zeros((rows.num_rows, len(parts), len(splits), dims + 1), dtype=np.int64)
            for p, part in enumerate(parts):
                a, n = spans[part][0], spans[part][1] - spans[part][0]
                for s, split in enumerate(splits):
                    if split.kind == "Segment":
                        lo, hi = (base + np.clip(a + (n / float(split.args[1]) * float(i)).astype(np.int64), 0, sizes) for i in (split.args[0] - 1, split.args[0]))
                        sums[:, p, s] = running[hi] - running[lo]
                        continue
                    for k in range(rows.num_rows):
                        where = a[k] + _positions(split, int(n[k]))
                        sums[k, p, s] = x[base[k] + where[(where >= 0) & (where < sizes[k])].astype(np.int64)].sum(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                value = (np.floor(sums[..., :dims] / sums[..., dims:] * (1e5 / unit) + 0.5 + 1e-7) / 1e5).reshape(rows.num_rows, -1)
            step = max(1, (1 << 16) // len(labels))
            for lo in range(0, rows.num_rows, step):
                mine = value[lo : lo + step]
                row = pa.array(np.repeat(np.arange(lo, lo + len(mine)), len(labels)))
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(row) for c in keep), pa.array(np.tile(np.arange(len(labels), dtype=np.int32), len(mine))), pa.array(mine.reshape(-1), mask=np.isnan(mine).reshape(-1))], names=[*keep, "_n", "value"])

    rows = df.select(*dict.fromkeys([*keep, "sequence", "tmd_start", "tmd_stop"])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_n int, value double"]))
    return rows.select(*keep, F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("_n") + 1).alias("feature"), "value")


def combined_of(df: DataFrame, sequence: str, tensors: Sequence[Callable[[np.ndarray], np.ndarray]], keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``keep, n, dims, total``: length, dimensions and sum of several tensors of one sequence side by side. Each tensor is a function of the numbers of the letters (20: another
    letter) to vectors, NaN where there are none. What belongs to one row needs no join by key: vectors are put together where the sequence is read, and only what is asked of
    them leaves the worker."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, codes, at in _read(batches, sequence):
            made = [t(codes) for t in tensors]
            if any(len(t) != len(codes) for t in made):
                raise ValueError("tensors of other lengths or keys")
            both = np.concatenate(made, axis=1)
            each = np.nansum(both, axis=1)
            total = np.array([each[a:b].sum() for a, b in zip(at[:-1], at[1:], strict=True)])
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(size.astype(np.int32)), pa.array(np.full(len(size), both.shape[1], np.int32), mask=size == 0), pa.array(total)], names=[*keep, "n", "dims", "total"])

    return df.select(*dict.fromkeys([*keep, sequence])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n int, dims int, total double"]))


def scale_tensor(scales: Mapping[str, Sequence[int]], unit: float = 100_000.0) -> Callable[[np.ndarray], np.ndarray]:
    """``residue_tensor`` for ``combined_of``."""
    table = np.array([[*(x / unit for x in v), np.nan] for v in scales.values()]).T
    return lambda codes: table[codes]


def letter_means(df: DataFrame, sequence: str, tensor: str, spark: SparkSession | None = None) -> DataFrame:
    """``aa, dim, mean, std``: what each letter is worth in each dimension, over all residues; null for letters that don't occur."""
    both = F.arrays_zip(letters_of(F.col(sequence)).alias("aa"), F.col(tensor).alias("v"))
    rows = df.select(F.explode(both).alias("_r")).select("_r.aa", F.posexplode("_r.v").alias("dim", "x"))
    found = rows.groupBy("aa", "dim").agg(F.avg("x").alias("mean"), F.sqrt(F.greatest(F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x"), F.lit(0.0))).alias("std"))
    every = df.sparkSession.createDataFrame([(a,) for a in LETTERS], "aa string").crossJoin(F.broadcast(found.select("dim").distinct()))
    return every.join(found, ["aa", "dim"], "left")


def combined(left: DataFrame, right: DataFrame, key: str, tensor: str) -> DataFrame:
    """Tensors of two frames side by side by key (those of one frame need no join: ``combined_of``); keys of one side only, and sequences of other lengths, raise when read."""
    both = left.join(right.withColumnRenamed(tensor, "_more"), key, "full_outer")
    same = F.assert_true(F.col(tensor).isNotNull() & F.col("_more").isNotNull() & (F.size(tensor) == F.size("_more")), F.lit("tensors of other lengths or keys"))
    return both.withColumn("_ok", same).withColumn(tensor, F.zip_with(tensor, "_more", lambda a, b: F.when(F.col("_ok").isNull(), F.concat(a, b)))).drop("_more", "_ok")
