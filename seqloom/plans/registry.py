"""All queries of the engine and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import charts, core, design, encoding, evaluation, extended, modelling, residues, tables, workflows  # noqa: F401
from .catalog import QUERIES, TWINS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
