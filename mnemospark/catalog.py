"""The registered queries: each takes (spark, directory of the tables) and returns a DataFrame; most have equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import history, moving, reads, text, vectors

_GROUPS = (vectors, text, history, reads, moving)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for group in _GROUPS for name, fn in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.SQL.items()}
