"""Checks that end in one number, or in one row per group.

All group results are plain hash aggregates: tasks fold their own rows before
the shuffle, so a group holding most of the rows stays one row per task.
Distinct counts within groups shuffle by group *and* value, for the same reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import column
from plumbline.functions.time import seconds_between


def row_count(df: DataFrame) -> DataFrame:
    """``n``: volume of a table, window or filter."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_band(df: DataFrame, low: int, high: int) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), n.between(low, high).alias("within"))


def since(time: Column, as_of: Column, span: str) -> Column:
    """Rows no older than ``span`` before ``as_of``; a bare-column range, so it is pushed down."""
    return time > as_of - F.expr(f"INTERVAL {span}")


def on_day(time: Column, day: Column) -> Column:
    """Rows of one calendar day, as a half-open range on the bare column."""
    start = day.cast("date").cast("timestamp_ntz")
    return (time >= start) & (time < start + F.expr("INTERVAL 1 DAY"))


def freshness(df: DataFrame, time: str, as_of: Column) -> DataFrame:
    """``age``: seconds since the newest row."""
    return df.agg(seconds_between(F.max(column(time)), as_of).alias("age"))


def group_freshness(df: DataFrame, group: str, time: str, as_of: Column, span: str) -> DataFrame:
    """Groups that have been silent for longer than ``span``."""
    newest = df.groupBy(column(group)).agg(F.max(column(time)).alias("last_seen"))
    return newest.where(F.col("last_seen") < as_of - F.expr(f"INTERVAL {span}"))


def oldest_pending(df: DataFrame, pending: Column, time: str, as_of: Column) -> DataFrame:
    """``age``: seconds since the oldest pending row, 0 when none is pending."""
    oldest = df.where(pending).agg(F.min(column(time)).alias("t"))
    return oldest.select(F.coalesce(seconds_between(F.col("t"), as_of), F.lit(0.0)).alias("age"))


def rate(df: DataFrame, hit: Column) -> DataFrame:
    """``rate``: share of rows that hit, NULL for no rows."""
    return df.agg(F.try_divide(F.count_if(hit).cast("double"), F.count(F.lit(1))).alias("rate"))


def null_rate(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.avg(column(name).isNull().cast("double")).alias("rate"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with ``n``.

    Text keys are counted by their digest; only texts that do repeat are then
    fetched, one of each after folding within tasks.
    """
    texts = [k for k in keys if isinstance(df.schema[k].dataType, T.StringType)]
    if not texts:
        return df.groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named = [(F.unhex(F.sha2(column(k), 256)) if k in texts else column(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    ids = [f"_k{i}" for i in range(len(keys))]
    again = df.select(*named).groupBy(*ids).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = df.select(*named, *[column(k).alias(f"_t{i}") for i, k in enumerate(keys) if k in texts])
    on = [rows[k].eqNullSafe(again[k]) for k in ids]
    found = rows.join(again, on).select(*[again[k] for k in ids], "n", *[f"_t{i}" for i, k in enumerate(keys) if k in texts])
    one = found.groupBy(*ids, "n").agg(*[F.first(f"_t{i}").alias(f"_t{i}") for i, k in enumerate(keys) if k in texts])
    return one.select(*[F.col(f"_t{i}" if k in texts else f"_k{i}").alias(k) for i, k in enumerate(keys)], "n")


def group_size_not(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Groups that do not hold exactly ``size`` rows."""
    return df.groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != size)


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """``dups``: rows minus distinct keys (NULL rows count, NULL keys do not)."""
    per_key = df.groupBy(column(key).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg((F.coalesce(F.sum("c"), F.lit(0)) - F.count("k")).alias("dups"))


def cardinality(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    """``n``: distinct values. The approximate form keeps a fixed-size sketch and does not shuffle."""
    count = F.approx_count_distinct(column(name)) if approximate else F.count_distinct(column(name))
    return df.agg(count.alias("n"))


def group_distinct_over(df: DataFrame, group: str, name: str, limit: int) -> DataFrame:
    """Groups with more than ``limit`` distinct values of a column."""
    return df.groupBy(column(group)).agg(F.count_distinct(column(name)).alias("n")).where(F.col("n") > limit)


def velocity_count(df: DataFrame, group: str, limit: int) -> DataFrame:
    """Groups with more than ``limit`` rows; filter ``df`` to the window first."""
    return df.groupBy(column(group)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def velocity_sum(df: DataFrame, group: str, amount: Column, limit: float) -> DataFrame:
    """Groups whose amount sums to more than ``limit``."""
    return df.groupBy(column(group)).agg(F.sum(amount).alias("total")).where(F.col("total") > limit)


def net_sum(df: DataFrame, amount: Column) -> DataFrame:
    """``net``: the sum, 0 for no rows."""
    return df.agg(F.coalesce(F.sum(amount), F.lit(0)).alias("net"))


def ratio_of_sums(df: DataFrame, part: Column, rest: Column) -> DataFrame:
    """``ratio``: part over part plus rest, NULL when both are zero."""
    return df.agg(F.try_divide(F.sum(part).cast("double"), F.sum(part) + F.sum(rest)).alias("ratio"))


def max_ratio(df: DataFrame, top: Column, bottom: Column) -> DataFrame:
    return df.agg(F.max(F.try_divide(top.cast("double"), bottom)).alias("ratio"))


def max_abs(df: DataFrame, amount: Column) -> DataFrame:
    return df.agg(F.coalesce(F.max(F.abs(amount)), F.lit(0)).alias("max_diff"))


def mean_lag(df: DataFrame, start: str, end: str) -> DataFrame:
    """``lag``: mean seconds from one time column to the other, 0 for no rows."""
    return df.agg(F.coalesce(F.avg(seconds_between(column(start), column(end))), F.lit(0.0)).alias("lag"))


def count_ratio(df: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """``ratio`` of two conditional row counts, in one pass; NULL when the second is zero."""
    return df.where(top | bottom).agg(
        F.try_divide(F.count_if(top).cast("double"), F.count_if(bottom)).alias("ratio")
    )
