"""Registration of queries and access to the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# The moments the time checks are evaluated at.
EVENTS_AS_OF = datetime(2024, 1, 30, 12)
ORDERS_AS_OF = datetime(2001, 7, 15)


class Tables:
    """The Parquet tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables`, with its SQL when there is one."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, root))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def at(moment: datetime) -> Column:
    """A moment as a zone-less timestamp literal, like the tables' own."""
    return F.lit(f"{moment:%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz")


def sql_at(moment: datetime) -> str:
    return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'"


def r6(col: Column | str) -> Column:
    return F.round(col, 6)
