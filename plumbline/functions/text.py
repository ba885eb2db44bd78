"""How values, rows and names are written in details, samples and reports."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def quote(text: str) -> str:
    """Double-quoted text with the usual escapes."""
    escaped = text.replace("\\", "\\\\").replace('"', '\\"')
    return '"' + escaped.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def debug_list(items: Sequence[str]) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


def plain_number(value: float) -> str:
    """Shortest text of a number, without exponent or trailing ``.0``."""
    if float(value).is_integer():
        return str(int(value))
    return format(Decimal(repr(float(value))), "f")


def present(col: Column, dtype: T.DataType) -> Column:
    """True where there is a value; NaN and infinities count as missing."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNotNull() & (F.abs(col) < F.lit(float("inf")))
    return col.isNotNull()


def finite(col: Column, dtype: T.DataType) -> Column:
    """The column with NaN and infinities read as NULL."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(F.abs(col) < F.lit(float("inf")), col)
    return col


def as_number(col: Column, dtype: T.DataType) -> Column:
    return finite(col, dtype).cast("double")


def rfc3339(col: Column, dtype: T.DataType) -> Column:
    """``2024-01-01T00:00:07+00:00``, with 3 or 6 fraction digits when needed."""
    ts = F.to_utc_timestamp(col, F.current_timezone()) if isinstance(dtype, T.TimestampType) else col
    fraction = F.date_format(ts, "SSSSSS")
    tail = (
        F.when(fraction == "000000", "")
        .when(F.endswith(fraction, F.lit("000")), F.concat(F.lit("."), F.left(fraction, F.lit(3))))
        .otherwise(F.concat(F.lit("."), fraction))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), tail, F.lit("+00:00"))


def plain_value(col: Column, dtype: T.DataType) -> Column:
    """A column as the plain value reports and rules see (see ``normalise``)."""
    if isinstance(dtype, INTEGRAL):
        return col.cast("bigint")
    if isinstance(dtype, NUMERIC):
        return as_number(col, dtype)
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dtype, TIMESTAMPS):
        return rfc3339(col, dtype)
    return col


def value_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a value: numbers and booleans printed, strings as they are."""
    return plain_value(col, dtype).cast("string")


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_text(schema: T.StructType) -> Column:
    """``key=val key=val ...`` over all columns of a row."""
    parts = [
        F.concat(F.lit(f"{f.name}="), F.coalesce(value_text(column(f.name), f.dataType), F.lit("null")))
        for f in schema.fields
    ]
    return F.concat_ws(" ", *parts)


def row_json(schema: T.StructType) -> Column:
    """The row as compact JSON, NULLs included."""
    plain = F.struct(*[plain_value(column(f.name), f.dataType).alias(f.name) for f in schema.fields])
    return F.to_json(plain, {"ignoreNullFields": "false"})
