"""Options with checks, a record of where a result comes from, and tables as HTML."""

from __future__ import annotations

import html
import platform
from collections.abc import Iterator, MutableMapping

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Options: their default, and what they may be (fixed values); "off" leaves the choice to the call.
_OPTIONS = {
    "verbose": ("off", lambda v: v in ("off", True, False)),
    "random_state": ("off", lambda v: v == "off" or (isinstance(v, int) and v >= 0)),
    "jmd_n_len": (10, lambda v: isinstance(v, int) and v >= 0),
    "jmd_c_len": (10, lambda v: isinstance(v, int) and v >= 0),
    "ext_len": (0, lambda v: isinstance(v, int) and v >= 0),
    "gap": ("-", lambda v: isinstance(v, str) and len(v) == 1),
}


class Options(MutableMapping):
    """Settings by name; unknown names and unfit values raise."""

    def __init__(self) -> None:
        self._set: dict = {}

    def __getitem__(self, name: str):
        return self._set[name] if name in self._set else _OPTIONS[name][0]

    def __setitem__(self, name: str, value) -> None:
        if name not in _OPTIONS:
            raise KeyError(f"no option {name!r}; there are {sorted(_OPTIONS)}")
        if not _OPTIONS[name][1](value):
            raise ValueError(f"{value!r} doesn't fit option {name!r}")
        self._set[name] = value

    def __delitem__(self, name: str) -> None:
        self._set.pop(name, None)

    def __iter__(self) -> Iterator[str]:
        return iter(_OPTIONS)

    def __len__(self) -> int:
        return len(_OPTIONS)

    def choose(self, name: str, given):
        """The option, or what the call gives where it is off or has been left alone."""
        value = self[name]
        return given if value == "off" or name not in self._set else value


options = Options()


def content_hash(df: DataFrame) -> DataFrame:
    """One row ``n_rows, hash``: of all rows, whatever their order and partitions. Repeated rows count (sums, not only exclusive ors)."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(sorted(df.columns))])))
    low = F.pmod(row, F.lit(1 << 31))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.hex(F.coalesce(F.bit_xor(row), F.lit(0)) + F.coalesce(F.sum(low), F.lit(0))).alias("hash"))


def provenance(df: DataFrame | None = None, random_state: int | None = None) -> dict:
    """Versions, seed and, of a table, its columns and content hash."""
    record = {"python": platform.python_version(), "pyspark": pyspark.__version__, "random_state": random_state}
    if df is not None:
        record |= {"columns": df.columns, **content_hash(df).first().asDict()}
    return record


def html_table(df: DataFrame, n_rows: int = 20, n_cols: int | None = None, char_limit: int = 30, max_height: int = 300) -> str:
    """The first rows as an HTML table in a box that scrolls; long cells are cut."""
    shown = df.columns[:n_cols]
    cell = lambda v: html.escape(s if len(s := "" if v is None else str(v)) <= char_limit else s[: char_limit - 1] + "…")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in shown)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in df.select(*[F.col(f"`{c}`") for c in shown]).limit(n_rows).collect())
    return f'<div style="max-height:{max_height}px;overflow:auto"><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></div>'
