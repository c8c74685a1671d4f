"""Composition of sequences: letters, k-mers, scales, auto-covariance, and fixed encodings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import GAP, LETTERS, UNIT, letter_counts
from ..functions.parts import sliding_windows
from .stats import round_half_up
from .windows import _texts as texts_of


def gap_free(parts: Sequence[str]) -> Column:
    """The parts put together, without anything but canonical letters; k-mers span the borders."""
    return F.regexp_replace(F.concat(*[F.col(p) for p in parts]), f"[^{LETTERS}]", "")


def letter_fractions(df: DataFrame, sequence: Column, keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``keep, aa, fraction``: 20 rows per sequence, null if it is empty."""
    counted = df.select(*keep, letter_counts(sequence).alias("_c"), F.length(sequence).alias("_n"))
    rows = F.arrays_zip(F.array(*[F.lit(a) for a in LETTERS]).alias("aa"), F.col("_c").alias("n"))
    return counted.select(*keep, "_n", F.explode(rows).alias("_r")).select(*keep, "_r.aa", F.when(F.col("_n") > 0, F.col("_r.n") / F.col("_n")).alias("fraction"))


def kmers(sequence: Column, k: int) -> Column:
    return sliding_windows(sequence, k)


#: Letters whose k-mers are counted at once.
_LETTERS_AT_ONCE = 1 << 20


def kmer_counts(df: DataFrame, sequence: Column, k: int, keep: Sequence[str] = ("entry",), together: bool = False) -> DataFrame:
    """``keep, kmer, n, total`` of the k-mers that occur in each row's sequence, and how many it has; counted where the row is read, so rows need no shuffle.
    ``together``: rows read at once are counted as one (for sums over all rows; ``keep`` and ``total`` are then those of the first)."""
    kinds = dict(df.dtypes)

    def of(sequences: list[str]) -> tuple:
        letters = np.frombuffer("".join(sequences).encode("utf-32-le"), np.uint32)
        names, codes = np.unique(letters, return_inverse=True)
        codes, base = codes.astype(np.int64), max(len(names), 2)
        sizes = np.array([len(s) for s in sequences], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        many = np.maximum(sizes - k + 1, 0)
        row = np.repeat(np.arange(len(sizes)), many)
        starts = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + at[row]
        row = np.zeros_like(row) if together else row
        word = np.zeros(len(starts), dtype=np.int64)
        for i in range(k):  # words become numbers again before they grow too large
            if i and base ** (i + 1) * len(sizes) >= 1 << 62:
                return None
            word = word * base + codes[starts + i]
        key, n = np.unique(row * base**k + word, return_counts=True)
        row, word = np.divmod(key, base**k)
        picked = np.stack([word // base ** (k - 1 - i) % base for i in range(k)], axis=1)
        return row, texts_of(names[picked]), n, many[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, first = batch.column("_s").to_pylist(), 0
            while first < len(told):
                last, size = first, 0
                while last < len(told) and (last == first or size + len(told[last] or "") <= _LETTERS_AT_ONCE):
                    size, last = size + len(told[last] or ""), last + 1
                mine = [s or "" for s in told[first:last]]
                made = of(mine)
                if made is None:
                    rows = [(i, w, n, len(s) - k + 1) for i, s in enumerate(mine) for w, n in Counter(s[j : j + k] for j in range(len(s) - k + 1)).items()]
                    made = tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [], [])
                row, word, n, total = made
                row = np.asarray(row, dtype=np.int64) + first
                if len(row):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in keep), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=[*keep, "kmer", "n", "total"])
                first = last

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "kmer string, n long, total long"])
    return df.select(*keep, sequence.alias("_s")).mapInArrow(run, schema)


def kmer_fractions(df: DataFrame, sequence: Column, k: int, keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``keep, kmer, n, fraction`` of the k-mers that occur in each row; the denominator is the number of k-mers."""
    rows = kmer_counts(df, sequence, k, keep)
    return rows.select(*keep, "kmer", "n", (F.col("n") / F.col("total").cast("int")).alias("fraction"))


def scale_composition(df: DataFrame, sequence: Column, scales: Mapping[str, Sequence[int]], keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``keep, scale_id, value``: the mean of each scale over the letters, null without letters."""
    counted = df.select(*keep, letter_counts(sequence).alias("_c"))
    n = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x)
    dot = lambda v: sum((F.col("_c")[i] * x for i, x in enumerate(v)), F.lit(0).cast("long"))
    rows = F.array(*[F.struct(F.lit(s).alias("scale_id"), F.when(n > 0, F.floor(dot(v) / n + 0.5) / float(UNIT)).alias("value")) for s, v in scales.items()])
    return counted.select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.scale_id", "_r.value")


def scale_series(sequence: Column, values: Sequence[int]) -> Column:
    """The scale's value of every letter, as an array of longs."""
    of = F.create_map(*[x for a, v in zip(LETTERS, values, strict=True) for x in (F.lit(a), F.lit(int(v)).cast("long"))])
    return F.transform(F.filter(F.split(sequence, ""), lambda a: a != ""), lambda a: F.element_at(of, a))


def auto_covariance(df: DataFrame, sequence: Column, scales: Mapping[str, Sequence[int]], lags: Sequence[int] = (1,), keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``keep, scale_id, lag, acc``: sum of (S_i - mean)(S_{i+lag} - mean) over N - lag; null where there are too few letters.

    The products are summed as whole numbers and the mean is taken out afterwards, so the result doesn't depend on the order.
    """
    table, names, kinds = np.array([[*v, 0] for v in scales.values()], dtype=np.int64), list(scales), dict(df.dtypes)
    code = np.full(256, 20, dtype=np.int64)
    code[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, bad = [], [], []
            for k, text in enumerate(batch.column("_s").to_pylist()):
                codes = code[np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)]
                x, n = table[:, codes], len(codes)
                total = x.sum(axis=1)
                for lag in lags:
                    head, tail = x[:, : max(n - lag, 0)], x[:, lag:]
                    out.append(np.stack([np.arange(len(names)), np.full(len(names), lag), np.full(len(names), n), total, (head * tail).sum(axis=1), head.sum(axis=1) + tail.sum(axis=1)], axis=1))
                    rows.append(np.full(len(names), k))
                    bad.append(np.full(len(names), text is None or bool((codes == 20).any())))
            if rows:
                told, bad = np.concatenate(out), np.concatenate(bad)
                columns = [pa.array(told[:, i]) for i in range(3)] + [pa.array(told[:, i], mask=bad) for i in range(3, 6)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(np.concatenate(rows))) for c in keep), *columns], names=[*keep, "_k", "_lag", "_n", "_sum", "_p", "_e"])

    made = df.select(*keep, sequence.alias("_s")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in ("_k", "_lag", "_n", "_sum", "_p", "_e"))]))
    m, d = F.col("_sum").cast("double") / F.nullif(F.col("_n"), F.lit(0)), (F.col("_n") - F.col("_lag")).cast("double")
    acc = (F.col("_p").cast("double") - m * F.col("_e").cast("double") + d * m * m) / F.nullif(d, F.lit(0.0)) / float(UNIT) / float(UNIT)
    scale = F.element_at(F.array(*[F.lit(s) for s in names]), (F.col("_k") + 1).cast("int"))
    return made.select(*keep, scale.alias("scale_id"), F.col("_lag").cast("int").alias("lag"), F.when(d > 0, round_half_up(acc, 6)).alias("acc"))


def integer_codes(sequence: Column) -> Column:
    """1 to 20 by letter, 0 for gaps and anything else."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return F.transform(F.filter(F.split(sequence, ""), lambda a: a != ""), lambda a: F.coalesce(F.array_position(letters, a), F.lit(0)).cast("int"))


def one_hot(df: DataFrame, sequence: str = "sequence", keep: Sequence[str] = ("entry",)) -> DataFrame:
    """``keep, pos, aa``: the ones of a one-hot encoding (sparse); gaps and other letters are all zero."""
    letters = df.select(*keep, F.posexplode(F.filter(F.split(sequence, ""), lambda a: a != "")).alias("_p", "aa"))
    return letters.filter(F.col("aa").isin(*LETTERS)).select(*keep, (F.col("_p") + 1).alias("pos"), "aa")


def pad_to_longest(df: DataFrame, column: str, gap: str = GAP, at: str = "C") -> DataFrame:
    """A column filled up to its longest value; the length is one number, broadcast to all rows."""
    longest = df.agg(F.max(F.length(column)).alias("_longest"))
    missing = F.repeat(F.lit(gap), F.col("_longest") - F.length(column))
    padded = F.concat(F.col(column), missing) if at == "C" else F.concat(missing, F.col(column))
    return df.crossJoin(F.broadcast(longest)).withColumn(column, padded).drop("_longest")


def extend_alphabet(scales: DataFrame, letter: str, how: str = "mean") -> DataFrame:
    """A new letter with the mean, median, least or greatest value of each scale."""
    agg = {"mean": F.avg("value"), "median": F.percentile("value", 0.5), "min": F.min("value").cast("double"), "max": F.max("value").cast("double")}[how]
    new = scales.groupBy("scale_id").agg(agg.alias("value")).select(F.lit(letter).alias("aa"), "scale_id", "value")
    return scales.select("aa", "scale_id", F.col("value").cast("double").alias("value")).unionByName(new)


def min_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values of each key scaled to [0, 1]; constant ones are 0."""
    ends = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(F.broadcast(ends), key).withColumn(value, F.when(span > 0, (F.col(value) - F.col("_lo")) / span).otherwise(0.0)).drop("_lo", "_hi")
