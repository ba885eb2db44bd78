"""Look at tables before writing checks: schema, sample rows, reachability."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import column, quote
from plumbline.sources.connections import first_line

# Bounds of a table sample and the form of a safe table name.
SAMPLE_DEFAULT, SAMPLE_MAX = 10, 100
SAFE_NAME = re.compile(r"[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*")
# Schemas that belong to the system, left out of a description.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "mysql", "performance_schema", "sys")


def safe_name(name: str, what: str = "table") -> str:
    if not SAFE_NAME.fullmatch(name):
        raise ValueError(f"invalid {what} name {quote(name)}: expected an identifier like `orders` or `public.orders`")
    return name


def describe_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column, in table and column order. Reads schemas only."""
    rows = [
        (table, i, f.name, f.dataType.simpleString(), f.nullable)
        for table, df in sorted(tables.items())
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    schema = "table_name string, ordinal int, column_name string, data_type string, nullable boolean"
    return spark.createDataFrame(rows, schema)


def describe_schema(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Columns of every table and view the session sees, or of one schema.

    One that cannot be resolved, say a view of a dropped table, is one row with
    ordinal 0, no column, and the error in place of a type.
    """
    if schema is not None:
        safe_name(schema, "schema")
    databases = [schema] if schema else [d.name for d in spark.catalog.listDatabases() if d.name not in SYSTEM_SCHEMAS]
    names: dict[str, DataFrame] = {}
    broken = []
    for database in databases:
        for table in spark.catalog.listTables(database):
            if table.isTemporary and schema is not None:
                continue
            full = table.name if table.isTemporary else f"{database}.{table.name}"
            try:
                names[full] = spark.table(full)
            except Exception as err:  # noqa: BLE001 - one broken view must not end the listing
                broken.append((full, 0, None, f"error: {first_line(err)}", None))
    found = describe_columns(spark, names)
    return found.unionAll(spark.createDataFrame(broken, found.schema)) if broken else found


def grouped_by_table(columns: DataFrame) -> DataFrame:
    """Column lists per table: ``table_name, columns`` in ordinal order."""
    entry = F.struct("ordinal", F.col("column_name").alias("name"), F.col("data_type").alias("type"), "nullable")
    return columns.groupBy("table_name").agg(F.array_sort(F.collect_list(entry)).alias("columns"))


def sample_table(df: DataFrame, limit: int | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """A few rows: 10 unless asked, between 1 and 100; any rows, or the first by ``order_by``."""
    n = min(max(SAMPLE_DEFAULT if limit is None else limit, 1), SAMPLE_MAX)
    if order_by is None:
        return df.limit(n)
    return df.orderBy(*[column(c).asc_nulls_first() for c in order_by]).limit(n)


def reachable(spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """Per table: ``ok`` is 1 where a row could be asked for, else 0 with the error's first line.

    Each table is probed by itself, with no more than one row; a function opens
    its table within the probe, so one that cannot even be opened is reported too.
    """
    rows = []
    for name, table in tables.items():
        try:
            (table() if callable(table) else table).limit(1).collect()
        except Exception as err:  # noqa: BLE001 - any failure is what this reports
            rows.append((name, 0, first_line(err)))
        else:
            rows.append((name, 1, None))
    return spark.createDataFrame(rows, "table_name string, ok int, error string")


def row_counts(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: how many rows a full read finds."""
    lines = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, lines) if lines else spark.createDataFrame([], "table_name string, n_rows bigint")


def probe(spark: SparkSession) -> bool:
    """The cheapest round trip: ``SELECT 1``."""
    return spark.sql("SELECT 1 AS ok").first()["ok"] == 1
