"""Checks whose result is the offending rows: conditions over one row.

Each returns a filtered DataFrame. Conditions stay on bare columns so that
Parquet statistics and partitions can prune.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import column


def older_than(time: Column, as_of: Column, span: str) -> Column:
    return time < as_of - F.expr(f"INTERVAL {span}")


def stuck(df: DataFrame, state: Column, time: str, as_of: Column, span: str) -> DataFrame:
    """Rows still in a state, last touched longer than ``span`` ago."""
    return df.where(state & older_than(column(time), as_of, span))


def not_accepted(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """Rows with a value outside the accepted ones; NULL is not flagged."""
    return df.where(~column(name).isin(list(values)))


def out_of_range(df: DataFrame, name: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows below ``low`` or above ``high``."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (column(name) < low)
    if high is not None:
        bad = bad | (column(name) > high)
    return df.where(bad)


def column_exceeds(df: DataFrame, name: str, limit: Column) -> DataFrame:
    """Rows where a column is above another column or expression."""
    return df.where(column(name) > limit)


def future_dated(df: DataFrame, time: str, as_of: Column) -> DataFrame:
    return df.where(column(time) > as_of)


def late_arriving(df: DataFrame, loaded: str, event: str, as_of: Column, load_span: str, event_span: str) -> DataFrame:
    """Rows loaded within ``load_span`` whose event is older than ``event_span``."""
    fresh = column(loaded) > as_of - F.expr(f"INTERVAL {load_span}")
    return df.where(fresh & older_than(column(event), as_of, event_span))


def stale_or_null(df: DataFrame, time: str, as_of: Column, span: str) -> DataFrame:
    return df.where(column(time).isNull() | older_than(column(time), as_of, span))


def blank(df: DataFrame, name: str) -> DataFrame:
    """Rows with NULL or empty text."""
    return df.where(column(name).isNull() | (column(name) == ""))


def expiring(df: DataFrame, time: str, as_of: Column, span: str) -> DataFrame:
    """Rows whose time lies between ``as_of`` and ``span`` later."""
    return df.where(column(time).between(as_of, as_of + F.expr(f"INTERVAL {span}")))


def implication_broken(df: DataFrame, state: Column, required: str) -> DataFrame:
    """Rows in a state that requires a value, without that value."""
    return df.where(state & column(required).isNull())


def text_search(df: DataFrame, name: str, pattern: str, negate: bool = False) -> DataFrame:
    """Rows whose text matches (or not) a case-insensitive ``LIKE`` pattern."""
    hit = column(name).ilike(pattern)
    return df.where(~hit if negate else hit)
