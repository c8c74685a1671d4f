"""Splits of a part: segments, patterns and periodic patterns.

A split is a small description enumerated on the driver; its letters are a column expression over the part.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    kind: str
    args: tuple

    @property
    def label(self) -> str:
        if self.kind == "Segment":
            return f"Segment({self.args[0]},{self.args[1]})"
        if self.kind == "Pattern":
            return f"Pattern({self.args[0]},{','.join(map(str, self.args[1]))})"
        end, one, two, start = self.args
        return f"PeriodicPattern({end},i+{one}/{two},{start})"

    def letters(self, part: Column) -> Column:
        """The letters of the part that belong to the split; positions past the end give none."""
        if self.kind == "Segment":
            i, n = self.args
            # the bounds are cut off doubles: length / n * i, in this order
            lo = (F.length(part) / float(n) * float(i - 1)).cast("int")
            hi = (F.length(part) / float(n) * float(i)).cast("int")
            return F.substring(part, lo + 1, hi - lo)
        turned = F.reverse(part) if self.args[0] == "C" else part
        if self.kind == "Pattern":
            return F.concat(*[F.substring(turned, F.lit(p), F.lit(1)) for p in self.args[1]])
        _, one, two, start = self.args
        on_step = lambda i: (i + 1 >= start) & ((i + 1 - start) % (one + two)).isin(0, one)
        return F.array_join(F.filter(F.split(turned, ""), lambda _, i: on_step(i)), "")

    def positions(self, length: int) -> list[int]:
        """1-based positions in a part of this length, in order."""
        if self.kind == "Segment":
            i, n = self.args
            return list(range(int(length / n * (i - 1)) + 1, int(length / n * i) + 1))
        if self.kind == "Pattern":
            at = list(self.args[1])
        else:
            _, one, two, start = self.args
            at, step = [], 0
            p = start
            while p <= length:
                at.append(p)
                p += two if step else one
                step = 1 - step
        return sorted(at if self.args[0] == "N" else [length + 1 - p for p in at])


def segments(n_min: int = 1, n_max: int = 15) -> list[Split]:
    return [Split("Segment", (i, n)) for n in range(n_min, n_max + 1) for i in range(1, n + 1)]


def patterns(steps: tuple[int, ...] = (3, 4), n_min: int = 2, n_max: int = 4, longest: int = 15) -> list[Split]:
    """All patterns of n_min to n_max positions with these steps between them, shifted as far as ``longest`` allows."""
    found = set()
    for n in range(n_min, n_max + 1):
        for chosen in product(steps, repeat=n):
            at = [sum(chosen[: k + 1]) for k in range(n)]
            for shift in range(-at[0] + 1, longest - at[-1] + 1):
                found.add(tuple(p + shift for p in at))
    return [Split("Pattern", (end, p)) for end in ("N", "C") for p in sorted(found)]


def periodic_patterns(steps: tuple[int, ...] = (3, 4)) -> list[Split]:
    return [Split("PeriodicPattern", (end, one, two, start)) for end in ("N", "C") for one, two in product(steps, repeat=2) for start in range(1, one + 1)]


def feature_id(part: Column | str, split: Column | str, scale: Column | str) -> Column:
    return F.concat_ws("-", part, split, scale)


def split_feature_id(feature: Column) -> Column:
    at = F.split(feature, "-")
    return F.struct(at[0].alias("part"), at[1].alias("split"), at[2].alias("scale_id"))
