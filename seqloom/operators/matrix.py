"""Feature values of many splits and scales at once, in Arrow batches.

A part's letters are counted once, between the sorted cuts of all segments, so a segment is a difference of two running counts and a pattern a
handful of picks. The counts (rows x splits x 20) times the scales (20 x scales) are all values. Statistics of features are added up
where the rows stand: a task hands on mergeable sums per feature, however many rows it has read, and only the survivors of a
pre-filter are computed a second time.
Sums before rounding follow from the sums of letter shares and of their products, whatever the number of scales; as rounding moves a value by
half a unit at most, they tell which features may be among the best, and only these are added up as rounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS, UNIT
from ..functions.splits import Split

_CODES = np.full(256, 20, dtype=np.int64)
_CODES[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(20)
#: Values and letters that are held at once, rows of one output batch, and values that are held until they are counted.
_VALUES, _LETTERS_AT_ONCE, _OUT, _COUNTED = 1 << 21, 1 << 19, 1 << 16, 1 << 23


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def letter_counts(column: pa.Array, splits: Sequence[Split]) -> np.ndarray:
    """``(rows, splits, 20)``: how often each letter occurs in each split of each (ASCII) text."""
    raw, at = _bytes(column)
    codes, rows, sizes = _CODES[raw], len(at) - 1, np.diff(at)
    out = np.zeros((rows, len(splits), 21), dtype=np.float64)
    segments = [(s, *split.args) for s, split in enumerate(splits) if split.kind == "Segment"]
    if segments and rows:
        ends = sorted({e for _, i, n in segments for e in ((i - 1, n), (i, n))})
        cuts = np.stack([(sizes / float(n) * float(i)).astype(np.int64) for i, n in ends], axis=1)
        order = np.argsort(cuts, axis=1, kind="stable")
        edges = np.concatenate([np.zeros((rows, 1), np.int64), np.take_along_axis(cuts, order, axis=1), sizes[:, None]], axis=1)
        pieces = edges.shape[1] - 1
        piece = np.repeat(np.arange(rows * pieces) * 21, np.diff(edges, axis=1).reshape(-1))
        running = np.bincount(piece + codes, minlength=rows * pieces * 21).reshape(rows, pieces, 21).cumsum(axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        every, at_end = np.arange(rows)[:, None], {e: k for k, e in enumerate(ends)}
        sums = running[every, place]
        out[:, [s for s, _, _ in segments]] = sums[:, [at_end[i, n] for _, i, n in segments]] - sums[:, [at_end[i - 1, n] for _, i, n in segments]]

    def where(end: str, p: np.ndarray) -> np.ndarray:
        """Places of the p-th letters from an end, a row each."""
        return at[:-1, None] + p - 1 if end == "N" else at[1:, None] - p

    def picked(end: str, p: np.ndarray) -> np.ndarray:
        """``(rows, len(p), 21)``: ones where the p-th letter is; none past the end."""
        there = p <= sizes[:, None]
        code = codes[np.where(there, where(end, p), 0)] if len(codes) else np.zeros(there.shape, np.int64)
        return (code[:, :, None] == np.arange(21)) & there[:, :, None]

    for end in ("N", "C"):
        mine = [(s, split.args[1]) for s, split in enumerate(splits) if split.kind == "Pattern" and split.args[0] == end]
        if mine and rows:
            steps = np.unique(np.concatenate([np.asarray(p, dtype=np.int64) for _, p in mine]))
            member = np.zeros((len(mine), len(steps)))
            for k, (_, p) in enumerate(mine):
                np.add.at(member[k], np.searchsorted(steps, p), 1)
            out[:, [s for s, _ in mine]] = np.matmul(member, picked(end, steps).astype(np.float64))
        periods = [(s, *split.args[1:]) for s, split in enumerate(splits) if split.kind == "PeriodicPattern" and split.args[0] == end]
        row = np.repeat(np.arange(rows), sizes) if periods else None
        for period in sorted({one + two for _, one, two, _ in periods}):
            # letters by their place in a period; a split takes two places, without what lies before its start
            place = (np.arange(len(codes)) - at[row] if end == "N" else at[row + 1] - 1 - np.arange(len(codes))) % period
            classes = np.bincount((row * period + place) * 21 + codes, minlength=rows * period * 21).reshape(rows, period, 21)
            for s, one, two, start in periods:
                if one + two == period:
                    for first in (start, start + one):
                        out[:, s] += classes[:, (first - 1) % period]
                        early = np.arange((first - 1) % period + 1, first, period)
                        if len(early):
                            out[:, s] -= picked(end, early).sum(axis=1)
    return out[:, :, :20]


def units_of(counts: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """``(rows, splits, scales)``: mean scale values in units of 1e-5, rounded half up; NaN without letters. ``scales``: (20, scales)."""
    n = counts.sum(axis=2)
    out = (counts.reshape(-1, 20) @ scales).reshape(*counts.shape[:2], scales.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        out /= n[:, :, None]
    out += 0.5
    return np.floor(out, out=out)  # 0 / 0 is NaN


def _table(scales: Mapping[str, Sequence[int]]) -> np.ndarray:
    return np.array(list(scales.values()), dtype=np.float64).T.reshape(20, -1)


def _slices(batch: pa.RecordBatch, parts: Sequence[str], width: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose values (``width`` a row) and letters are held at once; a row is never cut."""
    step = max(1, _VALUES // max(width, 1))
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(p)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts))
    first = 0
    while first < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _LETTERS_AT_ONCE, side="right"))
        last = max(first + 1, min(first + step, fit))
        yield batch.slice(first, last - first)
        first = last


class Chosen:
    """Units of single features: letters are counted for the splits that these have, and each split's counts meet its features' scales."""

    def __init__(self, numbers: Sequence[int], parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]]) -> None:
        self.numbers, self.parts = np.unique(np.asarray(numbers, dtype=np.int64)), list(parts)
        table, many, self.plan, self.width = _table(scales), len(scales), [], 0
        for k in range(len(parts)):
            mine = self.numbers[self.numbers // (len(splits) * many) == k]
            at, of = np.unique(mine // many % len(splits), return_inverse=True)
            if len(mine):
                self.plan.append((k, [splits[s] for s in at], [table[:, mine[of == i] % many] for i in range(len(at))]))
                self.width = max(self.width, 21 * len(at))
        self.width = max(self.width, len(self.numbers))

    def __call__(self, rows: pa.RecordBatch) -> np.ndarray:
        """``(rows, features)`` in the order of ``numbers``; NaN without letters."""
        out, at = np.empty((rows.num_rows, len(self.numbers))), 0
        for k, splits, tables in self.plan:
            counts = letter_counts(rows.column(self.parts[k]), splits)
            n = counts.sum(axis=2)
            for s, table in enumerate(tables):
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[:, at : at + table.shape[1]] = np.floor(counts[:, s] @ table / n[:, s, None] + 0.5)
                at += table.shape[1]
        return out


def feature_name(index: Column, parts: Sequence[str], splits: Sequence[Split], scales: Sequence[str]) -> dict[str, Column]:
    """part, split, scale_id and feature of a feature's number."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    part, split, scale = pick([p.upper() for p in parts], F.floor(index / (len(splits) * len(scales)))), pick([s.label for s in splits], F.floor(index / len(scales)) % len(splits)), pick(list(scales), index % len(scales))
    return {"part": part, "split": split, "scale_id": scale, "feature": F.concat_ws("-", part, split, scale)}


def matrix_values(df_parts: DataFrame, parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]], keep: Sequence[str] = ("entry",), only: Sequence[int] | None = None) -> DataFrame:
    """``keep, part, split, scale_id, value, feature``: a row per entry and feature (``only``: features of these numbers). Values are null without letters."""
    table, names = _table(scales), list(scales)
    chosen = None if only is None else Chosen(only, parts, splits, scales)
    kinds = dict(df_parts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = len(parts) * len(splits) * len(names)
            for part in _slices(batch, parts, width if chosen is None else chosen.width):
                if chosen is None:
                    number, units = np.arange(width), np.stack([units_of(letter_counts(part.column(p), splits), table) for p in parts], axis=1).reshape(part.num_rows, width)
                else:
                    number, units = chosen.numbers, chosen(part)
                for lo in range(0, units.size, _OUT):
                    flat = np.arange(lo, min(lo + _OUT, units.size))
                    value = units.reshape(-1)[flat]
                    columns = [part.column(c).take(pa.array(flat // len(number))) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(number[flat % len(number)]), pa.array(value / UNIT, mask=np.isnan(value))], names=[*keep, "_number", "value"])

    rows = df_parts.select(*keep, *parts).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_number long", "value double"]))
    name = feature_name(F.col("_number"), parts, splits, names)
    return rows.select(*keep, *[name[c].alias(c) for c in ("part", "split", "scale_id")], "value", name["feature"].alias("feature"))


def matrix_moments(df_parts: DataFrame, parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]], label: str = "label", test: int = 1, ref: int = 0, only: Sequence[int] | None = None) -> DataFrame:
    """``number, feature, scale_id, n_test, sum_test, sq_test, n_ref, sum_ref, sq_ref`` of all parts x splits x scales (``only``: of features of these numbers): what ``group_moments``
    says of the values, without a row per value. A task's memory is six numbers per feature and a slice of values."""
    table, names = _table(scales), list(scales)
    width = len(parts) * len(splits) * len(names)
    chosen = None if only is None else Chosen(only, parts, splits, scales)
    numbers = np.arange(width) if chosen is None else chosen.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 3, len(numbers)), dtype=np.int64)

        def add(units: np.ndarray, g: int, span: slice) -> None:
            there = ~np.isnan(units)
            if not there.all():
                np.nan_to_num(units, copy=False, nan=0.0)
            sums[g, 0, span] += there.sum(axis=0)
            sums[g, 1, span] += units.sum(axis=0).astype(np.int64)
            sums[g, 2, span] += np.einsum("ij,ij->j", units, units).astype(np.int64)

        for batch in batches:
            for part in _slices(batch, parts, width // len(parts) if chosen is None else chosen.width):
                told = part.column(label).fill_null(-1).to_numpy(zero_copy_only=False)
                if chosen is not None:
                    units = chosen(part)
                    for g, value in enumerate((test, ref)):
                        add(units[told == value], g, slice(None))
                    continue
                for at, p in enumerate(parts):
                    counts = letter_counts(part.column(p), splits)
                    span = slice(at * width // len(parts), (at + 1) * width // len(parts))
                    for g, value in enumerate((test, ref)):
                        add(units_of(counts[told == value], table).reshape(-1, width // len(parts)), g, span)
        for lo in range(0, len(numbers), _OUT):
            hi = min(lo + _OUT, len(numbers))
            columns = [pa.array(numbers[lo:hi]), *(pa.array(sums[g, k, lo:hi]) for g in (0, 1) for k in (0, 1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["number", *(f"{c}_{g}" for g in ("test", "ref") for c in ("n", "sum", "sq"))])

    part = df_parts.select(label, *parts).mapInArrow(run, "number long, n_test long, sum_test long, sq_test long, n_ref long, sum_ref long, sq_ref long")
    total = part.groupBy("number").agg(*[F.sum(c).alias(c) for c in part.columns[1:]])
    name = feature_name(F.col("number"), parts, splits, names)
    return total.select("number", name["feature"].alias("feature"), name["scale_id"].alias("scale_id"), *part.columns[1:])


def matrix_bounds(df_parts: DataFrame, parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]], max_std: float, label: str = "label", test: int = 1, ref: int = 0) -> DataFrame:
    """``number, low, high, sure`` of the features whose deviation in the test group may be ``max_std`` at most (``sure``: is so in any case): between which bounds the absolute
    mean difference of the rounded values lies; -1 where a group has no values.

    A mean before rounding is a sum of letter shares times the scale, its square one of products of shares, so a task adds up 20 + 400 numbers a split, not two a feature. Rounding moves
    each value by half a unit at most, and so each mean and each deviation."""
    table, many = _table(scales), len(splits)
    most = float(np.abs(table).max(initial=0))
    slop, wide = 1.25 + 1e-9 * most, 1.0 + 1e-11 * most**2 / max(max_std * UNIT, 1.0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(parts), many, 2, 421))
        for batch in batches:
            for part in _slices(batch, parts, 21 * many):
                told = part.column(label).fill_null(-1).to_numpy(zero_copy_only=False)
                for at, p in enumerate(parts):
                    counts = letter_counts(part.column(p), splits)
                    n = counts.sum(axis=2)
                    for g, value in enumerate((test, ref)):
                        mine = told == value
                        share = (counts[mine] / np.maximum(n[mine], 1)[:, :, None]).transpose(1, 0, 2)
                        sums[at, :, g, 0] += (n[mine] > 0).sum(axis=0)
                        sums[at, :, g, 1:21] += share.sum(axis=1)
                        sums[at, :, g, 21:] += np.matmul(share.transpose(0, 2, 1), share).reshape(many, 400)
        for lo in range(0, len(parts) * many, 128):
            hi = min(lo + 128, len(parts) * many)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array([x.tobytes() for x in sums.reshape(-1, 842)[lo:hi]], pa.binary())], names=["split", "sums"])

    def bounds(told: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer(), np.float64) for x in told.column("sums").combine_chunks()).reshape(2, 421)
        mean, n = [sums[g, 1:21] @ table / max(sums[g, 0], 1) for g in (0, 1)], sums[:, 0]
        square = np.einsum("as,as->s", table, sums[0, 21:].reshape(20, 20) @ table) / max(n[0], 1)
        std = np.sqrt(np.maximum(square - mean[0] ** 2, 0.0))
        dif = np.abs(mean[0] - mean[1])
        may = (std - wide <= max_std * UNIT) & (n[0] > 0)
        known = n.min() > 0
        number = told.column("split")[0].as_py() * table.shape[1] + np.flatnonzero(may)
        low, high = ((dif[may] + sign * slop) / UNIT if known else np.full(may.sum(), -1.0) for sign in (-1, 1))
        return pa.table({"number": number, "low": low, "high": high, "sure": (std + wide <= max_std * UNIT)[may]})

    return df_parts.select(label, *parts).mapInArrow(add, "split long, sums binary").groupBy("split").applyInArrow(bounds, "number long, low double, high double, sure boolean")


def matrix_sums(df_parts: DataFrame, parts: Sequence[str], splits: Sequence[Split], scales: Mapping[str, Sequence[int]], only: Sequence[int], label: str = "label", test: int = 1, ref: int = 0) -> DataFrame:
    """``feature, rank_sum2, n_test, sum_test, sq_test, n_ref, sum_ref, sq_ref`` of the features of these numbers that have values in either group: twice the test group's sum of
    average ranks, and the moments. Tasks count the values of a feature and hand on the counts as one row, so no value is a row."""
    chosen, names = Chosen(only, parts, splits, scales), list(scales)
    keys = ("rank_sum2", *(f"{c}_{g}" for g in ("test", "ref") for c in ("n", "sum", "sq")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list) -> Iterator[pa.RecordBatch]:
            units, of = np.concatenate([u for u, _ in held], axis=1), np.concatenate([g for _, g in held])
            for lo in range(0, len(units), 64):
                rows = []
                for number, row in zip(chosen.numbers[lo : lo + 64], units[lo : lo + 64], strict=True):
                    there = ~np.isnan(row)
                    value, n = np.unique(row[there].astype(np.int64) * 2 + of[there], return_counts=True)
                    if len(value):
                        rows.append((number, value.tobytes(), n.astype(np.int32).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["number", "value", "n"])

        held, size = [], 0
        for batch in batches:
            for part in _slices(batch, parts, chosen.width):
                told = part.column(label).fill_null(-1).to_numpy(zero_copy_only=False)
                mine = (told == test) | (told == ref)
                units = chosen(part)[mine].T.copy()
                held.append((units, (told[mine] == ref).astype(np.int64)))
                size += units.size
                if size >= _COUNTED:
                    yield from counted(held)
                    held, size = [], 0
        if size:
            yield from counted(held)

    def ranked(told: pa.Table) -> pa.Table:
        value, n = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in told.column(c).combine_chunks()]) for c, kind in (("value", np.int64), ("n", np.int32)))
        unit, at = np.unique(value >> 1, return_inverse=True)
        t, r = (np.bincount(at[value & 1 == g], n[value & 1 == g], len(unit)).astype(np.int64) for g in (0, 1))
        before = np.cumsum(t + r) - t - r
        sums = [((before * 2 + t + r + 1) * t).sum(), *(x for c in (t, r) for x in (c.sum(), (unit * c).sum(), (unit * unit * c).sum()))]
        return pa.table({"number": told.column("number")[:1], **{k: [int(x)] for k, x in zip(keys, sums, strict=True)}})

    rows = df_parts.select(label, *parts).mapInArrow(count, "number long, value binary, n binary")
    sums = rows.groupBy("number").applyInArrow(ranked, ", ".join(["number long", *(f"{k} long" for k in keys)]))
    return sums.select(feature_name(F.col("number"), parts, splits, names)["feature"].alias("feature"), *keys)
