"""Latest rows: gates on the most recent run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from plumbline.functions.text import column


def nth_latest(df: DataFrame, time: str, n: int = 0, tie_break: Sequence[str] = ()) -> DataFrame:
    """The n-th newest row (0 is the newest); each task keeps only n + 1 rows."""
    ordered = df.orderBy(column(time).desc_nulls_last(), *[column(c) for c in tie_break])
    return (ordered.offset(n) if n else ordered).limit(1)
