"""Reduce a result to plain value types, or say which column cannot be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import NUMERIC, TIMESTAMPS, column, plain_value, quote

SUPPORTED = NUMERIC + TIMESTAMPS + (T.BooleanType, T.StringType, T.CharType, T.VarcharType, T.DateType, T.NullType)


def unsupported_column(schema: T.StructType) -> str | None:
    """Why the first column of an unsupported type cannot be checked, if any."""
    for field in schema.fields:
        if not isinstance(field.dataType, SUPPORTED):
            return f"column {quote(field.name)} has unhandled type {field.dataType.simpleString()}"
    return None


def normalise(df: DataFrame) -> DataFrame:
    """Integers to bigint, other numbers to double, dates and times to text."""
    problem = unsupported_column(df.schema)
    if problem:
        raise ValueError(problem)
    return df.select(*[plain_value(column(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def type_error_row(df: DataFrame, check: str, status: str) -> DataFrame | None:
    """The one-row outcome of a check whose result has an unsupported column, if it has."""
    problem = unsupported_column(df.schema)
    if problem is None:
        return None
    return df.sparkSession.range(1).select(
        F.lit(check).alias("check"), F.lit(status).alias("status"), F.lit(problem).alias("detail"),
        F.array().cast("array<string>").alias("sample"),
    )
