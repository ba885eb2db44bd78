"""Schema contracts: answered from a table's schema, plus its row count if asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_count(df: DataFrame) -> DataFrame:
    """``n`` columns of a table and its ``n_rows``."""
    return df.agg(F.lit(len(df.columns)).cast("bigint").alias("n"), F.count(F.lit(1)).alias("n_rows"))


def required_present(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``present``: how many of the required columns exist."""
    present = len(set(required) & set(df.columns))
    return df.agg(F.lit(present).cast("bigint").alias("present"), F.count(F.lit(1)).alias("n_rows"))


def type_matches(df: DataFrame, name: str, types: Sequence[str]) -> DataFrame:
    """``n``: 1 when the column exists with one of the types (Spark type names)."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.agg(F.lit(int(found.get(name) in types)).cast("bigint").alias("n"), F.count(F.lit(1)).alias("n_rows"))
