"""Registered queries of the analysis and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..sources.tables import ORACLE

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at six places, ties upwards (and no negative zero), so that the order of sums doesn't show: times are multiples of 1/160 and their means often lie half-way."""
    return df.select(*[(F.bround(F.col(f.name) + F.lit(1e-9), places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema])


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``sql`` is a SELECT over the canonical views and ``views``."""

    def add(f: Callable) -> Callable:
        def run(spark, sf_dir):
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = f"with recursive {ORACLE}{views} {sql}"
        return f

    return add


def r(*exprs: str) -> str:
    """``expr as name`` items, rounded as ``rounded`` does."""
    out = []
    for e in exprs:
        x, _, name = e.rpartition(" as ")
        out.append(f"round_even(({x}) + 1e-9::double, 6) + 0.0::double as {name}")
    return ", ".join(out)
