"""Parts of a sequence: a middle (tmd) with a left and a right flank (jmd_n, jmd_c), and what is put together from them.

All are column expressions over sequence, tmd_start and tmd_stop (1-based, inclusive), so a projection computes them without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alphabet import GAP, LETTERS

ALL_PARTS = ("tmd", "tmd_e", "tmd_n", "tmd_c", "jmd_n", "jmd_c", "ext_c", "ext_n", "tmd_jmd", "jmd_n_tmd_n", "tmd_c_jmd_c", "ext_n_tmd_n", "tmd_c_ext_c")
DEFAULT_PARTS = ("tmd", "jmd_n_tmd_n", "tmd_c_jmd_c")


def base_parts(sequence: Column, start: Column, stop: Column, jmd_n_len: int = 10, jmd_c_len: int = 10) -> dict[str, Column]:
    """The three base parts; flanks that run out of sequence are filled up with gaps on their outer side."""
    left = F.greatest(start - jmd_n_len, F.lit(1))
    n = F.substring(sequence, left, start - left)
    c = F.substring(sequence, stop + 1, F.lit(jmd_c_len))
    return {"tmd": F.substring(sequence, start, stop - start + 1), "jmd_n": F.lpad(n, jmd_n_len, GAP), "jmd_c": F.rpad(c, jmd_c_len, GAP)}


def part_columns(tmd: Column, jmd_n: Column, jmd_c: Column, ext_len: int = 0) -> dict[str, Column]:
    """All 13 parts. The tmd's halves meet at half its length, rounded half to even."""
    size = F.length(tmd)
    half = F.bround(size / 2, 0).cast("int")
    tmd_n, tmd_c = F.substring(tmd, F.lit(1), half), F.substring(tmd, half + 1, size - half)
    ext_n = F.substring(jmd_n, F.length(jmd_n) - ext_len + 1, F.lit(ext_len)) if ext_len else F.lit("")
    ext_c = F.substring(jmd_c, F.lit(1), F.lit(ext_len)) if ext_len else F.lit("")
    return {
        "tmd": tmd, "tmd_e": F.concat(ext_n, tmd, ext_c), "tmd_n": tmd_n, "tmd_c": tmd_c, "jmd_n": jmd_n, "jmd_c": jmd_c, "ext_c": ext_c, "ext_n": ext_n,
        "tmd_jmd": F.concat(jmd_n, tmd, jmd_c), "jmd_n_tmd_n": F.concat(jmd_n, tmd_n), "tmd_c_jmd_c": F.concat(tmd_c, jmd_c), "ext_n_tmd_n": F.concat(ext_n, tmd_n), "tmd_c_ext_c": F.concat(tmd_c, ext_c),
    }


def get_parts(df_seq: DataFrame, parts: tuple[str, ...] = DEFAULT_PARTS, jmd_n_len: int = 10, jmd_c_len: int = 10, ext_len: int = 0, keep: tuple[str, ...] = ("entry",), drop_gaps: bool = False, replace: bool = False) -> DataFrame:
    """One column per part, from positions (sequence, tmd_start, tmd_stop), from parts (jmd_n, tmd, jmd_c) or from a sequence alone
    (the flanks are then its ends). ``drop_gaps``: without rows that have a gap in a part; ``replace``: other letters become gaps."""
    names = set(df_seq.columns)
    if {"jmd_n", "tmd", "jmd_c"} <= names:
        base = {p: F.col(p) for p in ("tmd", "jmd_n", "jmd_c")}
    else:
        start = F.col("tmd_start") if "tmd_start" in names else F.lit(jmd_n_len + 1)
        stop = F.col("tmd_stop") if "tmd_stop" in names else F.length("sequence") - jmd_c_len
        base = base_parts(F.col("sequence"), start, stop, jmd_n_len, jmd_c_len)
    made = part_columns(base["tmd"], base["jmd_n"], base["jmd_c"], ext_len)
    out = df_seq.select(*keep, *[(F.regexp_replace(made[p], f"[^{LETTERS}]", GAP) if replace else made[p]).alias(p) for p in parts])
    return without_gaps(out, parts) if drop_gaps else out


def without_gaps(df_parts: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    keep = F.lit(True)
    for p in parts:
        keep = keep & ~F.contains(F.col(p), F.lit(GAP))
    return df_parts.filter(keep)


def long_parts(df_parts: DataFrame, parts: tuple[str, ...], keep: tuple[str, ...] = ("entry",)) -> DataFrame:
    """``keep, part, seq``: a row per part."""
    return df_parts.select(*keep, F.explode(F.array(*[F.struct(F.lit(p.upper()).alias("part"), F.col(p).alias("seq")) for p in parts])).alias("_p")).select(*keep, "_p.part", "_p.seq")


def pad(sequence: Column, length: int | Column, gap: str = GAP, at: str = "C") -> Column:
    """Fill up to ``length`` at the end (C) or the beginning (N); longer ones stay as they are."""
    missing = F.repeat(F.lit(gap), F.greatest((F.lit(length) if isinstance(length, int) else length) - F.length(sequence), F.lit(0)))
    return F.concat(sequence, missing) if at == "C" else F.concat(missing, sequence)


def window_offsets(size: int) -> tuple[int, int]:
    """How far a window reaches left of its centre, and where it ends (exclusive)."""
    return (size - 1) // 2, size - (size - 1) // 2


def window_at(sequence: Column, start: Column, size: int, gap: str = GAP) -> Column:
    """The window from a 1-based start, filled up with gaps past the end."""
    return F.rpad(F.substring(sequence, start, F.lit(size)), size, gap)


def letters_of(sequence: Column) -> Column:
    """The letters as an array (empty for an empty sequence)."""
    return F.filter(F.split(sequence, ""), lambda a: a != "")


def window_of(letters: Column, start: Column, size: int) -> Column:
    """``size`` letters from a 1-based start, picked one by one: a substring walks to its start, a slice copies the whole array."""
    return F.concat(*[F.get(letters, start + (k - 1)) for k in range(size)])


def bound_once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def sliding_windows(sequence: Column, size: int) -> Column:
    """Array of all windows; empty if the sequence is shorter."""
    n = F.length(sequence) - size + 1
    every = bound_once(letters_of(sequence), lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - size + 1, F.lit(1))), lambda i: window_of(x, i, size)))
    return F.when(n > 0, every).otherwise(F.array().cast("array<string>"))


def explode_anchors(df_seq: DataFrame, pos: str = "pos", size: int = 9) -> DataFrame:
    """A row per anchor position: ``entry_win`` (entry_start-stop), start, stop and window; windows that don't fit entirely go."""
    left, right = window_offsets(size)
    out = df_seq.withColumn("_pos", F.explode(pos)).withColumn("start", F.col("_pos") - left).withColumn("stop", F.col("_pos") + right - 1)
    out = out.filter((F.col("start") >= 1) & (F.col("stop") <= F.length("sequence")))
    return out.withColumn("entry_win", F.concat(F.col("entry").cast("string"), F.lit("_"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"))).withColumn("window", F.substring("sequence", F.col("start"), F.lit(size))).drop("_pos")


def window_between(sequence: Column, start: int, stop: int, index1: bool = False, gap: str = GAP) -> Column:
    """The letters from ``start`` to ``stop``, both included, counted from 0 (or from 1), filled up with gaps past the end."""
    size = stop - start + 1
    return F.rpad(F.substring(sequence, start if index1 else start + 1, size), size, gap)


def windows_between(sequence: Column, size: int, first: int = 0, last: int | None = None, index1: bool = False) -> Column:
    """Array of (start, window) of all windows that lie between ``first`` and ``last`` (the end if none), in the counting asked for."""
    shift = 0 if index1 else 1
    end = F.length(sequence) if last is None else F.least(F.length(sequence), F.lit(last + shift))
    starts = F.sequence(F.lit(first + shift), F.greatest(end - size + 1, F.lit(first + shift)))
    every = F.transform(starts, lambda i: F.struct((i - shift).cast("int").alias("start"), F.substring(sequence, i, F.lit(size)).alias("window")))
    return F.filter(every, lambda w: F.length(w["window"]) == size)


def even_windows(df: DataFrame, size: int) -> DataFrame:
    """``entry, sequence, label`` of all windows of even ``size`` around a bond, from ``df(entry, sequence, labels array)``: named ``<entry>_<i>|<i+1>``, positive if the residues on
    both sides are. Windows past an edge go. They are cut in batches, so no row carries a sequence."""
    half, kind = size // 2, dict(df.dtypes)["entry"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, told = batch.column("sequence")[k].as_py(), batch.column("labels")[k]
                n = len(text or "")
                if n < size:
                    continue
                letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                lab = np.full(n + 1, np.nan)
                if told.is_valid:
                    values = told.values.to_numpy(zero_copy_only=False).astype(float)[:n]
                    lab[: len(values)] = values
                i = np.arange(half, n - half + 1)
                a, b = lab[i], lab[i - 1]
                unknown = (np.isnan(a) & (np.isnan(b) | (b == 1))) | (np.isnan(b) & (a == 1))
                windows = np.lib.stride_tricks.sliding_window_view(letters, size)[i - half]
                if letters.max() < 128:
                    ends = (np.arange(len(i) + 1) * size).astype(np.int32)
                    words = pa.StringArray.from_buffers(len(i), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(windows.astype(np.uint8))))
                else:
                    words = pa.array([w.tobytes().decode("utf-32-le") for w in np.ascontiguousarray(windows)])
                both = pa.array(((a == 1) & (b == 1)).astype(np.int32), mask=unknown)
                yield pa.RecordBatch.from_arrays([batch.column("entry").take(pa.array(np.full(len(i), k))), pa.array(i.astype(np.int32)), words, both], names=["entry", "i", "sequence", "label"])

    rows = df.select("entry", "sequence", "labels").mapInArrow(run, f"entry {kind}, i int, sequence string, label int")
    return rows.select(F.concat(F.col("entry").cast("string"), F.lit("_"), F.col("i").cast("string"), F.lit("|"), (F.col("i") + 1).cast("string")).alias("entry"), "sequence", "label")


def apply_policy(df: DataFrame, policy: str, column: str = "sequence") -> DataFrame:
    """What happens to sequences with other than the canonical letters: ``keep`` them, ``remove`` them, or put a ``gap`` for each such letter."""
    if policy == "remove":
        return df.filter(~F.col(column).rlike(f"[^{LETTERS}]"))
    return df.withColumn(column, F.regexp_replace(column, f"[^{LETTERS}]", GAP)) if policy == "gap" else df


def pad_frame(df_parts: DataFrame, parts: tuple[str, ...], gap: str = GAP, at: str = "C") -> DataFrame:
    """Parts filled up to the longest of each."""
    longest = df_parts.agg(*[F.max(F.length(p)).alias(f"_{p}") for p in parts])
    joined = df_parts.crossJoin(F.broadcast(longest))
    return joined.withColumns({p: pad(F.col(p), F.col(f"_{p}"), gap, at) for p in parts}).drop(*[f"_{p}" for p in parts])


def parts_of_windows(windows: dict[str, DataFrame], order: str) -> DataFrame:
    """``entry, <part>...``: the k-th window of each set (by ``order``) makes the k-th row, named REF<k>; rows end with the shortest set.

    Rows are numbered by their place within ranges of ``order`` that are sorted apart, and the ranges' counts, which are few, are added up. The ranges are sampled, so each
    set is ranged once and written: counts and numbers of two plans could come from different ranges."""
    from ..llm._common import cut

    out = None
    for part, rows in windows.items():
        ranged = rows.repartitionByRange(order).sortWithinPartitions(order).select(F.col("window").alias(part), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
        numbered = cut(ranged.withColumn("_k", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)))
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        firsts = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_first")
        one = numbered.join(F.broadcast(firsts), "_p").select((F.col("_k") + F.col("_first")).alias("_i"), part)
        out = one if out is None else out.join(one, "_i")
    return out.select(F.concat(F.lit("REF"), F.col("_i").cast("string")).alias("entry"), *windows)
