"""The queries of the core and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacquer.operators import intervals, nested, packed
from lacquer.plans import music, music2, music3  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p3_found": nested.p3_found,
        "p6_found": intervals.p6_found,
        "p7_found": packed.p7_found,
    } | music.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p6_found": intervals.P6_SQL} | music.SQL
