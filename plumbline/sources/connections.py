"""Named connections: each gives a session in which its tables are views.

A connection is opened once per suite run. Opening only resolves schemas, so an
unreachable source fails here, without a job, and takes down its own checks
only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Loader = Callable[[SparkSession], Mapping[str, DataFrame]]


@dataclass(frozen=True)
class Connection:
    """``load`` returns the connection's tables by name, as lazy DataFrames."""

    name: str
    load: Loader
    options: Mapping[str, Any] = field(default_factory=dict)
    """Reader options of a database that runs the checks' SQL itself."""
    live: bool = False
    """Whether rows may change while a check reads them; each result is then fetched once."""


def parquet_connection(name: str, root: str, tables: Sequence[str], suffix: str = ".parquet") -> Connection:
    """Parquet tables ``root/<table><suffix>``, each a file or a folder."""
    return Connection(name, lambda spark: {t: spark.read.parquet(f"{root}/{t}{suffix}") for t in tables})


def catalog_connection(name: str, tables: Sequence[str], database: str | None = None) -> Connection:
    """Tables of the session catalog (a metastore, Glue, ...)."""
    prefix = f"{database}." if database else ""
    return Connection(name, lambda spark: {t: spark.table(prefix + t) for t in tables})


def jdbc_connection(name: str, url: str, tables: Mapping[str, Mapping[str, Any]], **options: Any) -> Connection:
    """Tables of a database. Give each large one ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` so executors read it side by side."""

    def load(spark: SparkSession) -> Mapping[str, DataFrame]:
        reader = spark.read.format("jdbc").options(url=url, **options)
        return {t: reader.options(dbtable=t, **extra).load() for t, extra in tables.items()}

    return Connection(name, load, live=True)


def jdbc_query_connection(name: str, url: str, **options: Any) -> Connection:
    """A database that runs each check's SQL itself; only its rows travel.

    The text goes to the reader's ``query`` option unchanged, so it is written
    in the database's own SQL. Rows come through one connection: for results too
    large for that, use :func:`jdbc_connection` with partitioned tables.
    """
    return Connection(name, lambda spark: {}, {"url": url, **options}, live=True)


def query_reader(spark: SparkSession, options: Mapping[str, Any], sql: str) -> dict[str, Any]:
    """The reader options that send ``sql`` to the database."""
    return {**options, "query": sql.strip().rstrip(";")}


def frame_connection(name: str, frames: Mapping[str, DataFrame]) -> Connection:
    """Tables that are DataFrames already; the connection's views do not touch their own session."""
    return Connection(name, lambda spark: frames)


def static_connection(name: str, rows: Mapping[str, tuple[Sequence[Any], str]]) -> Connection:
    """Small fixed rows with a schema text, for lookups and tests."""
    return Connection(name, lambda spark: {t: spark.createDataFrame(list(r), schema) for t, (r, schema) in rows.items()})


def scoped_session(spark: SparkSession) -> SparkSession:
    """A session with its own views and the same SQL settings."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key) and session.conf.get(key, None) != value:
            session.conf.set(key, value)
    return session


def _show(df: DataFrame, session: SparkSession, table: str) -> None:
    """Make ``df`` a view of ``session`` alone, by way of a global view that goes at once."""
    if df.sparkSession is session:
        df.createOrReplaceTempView(table)
        return
    passing = f"plumbline_{uuid.uuid4().hex}"
    df.createGlobalTempView(passing)
    try:
        session.table(f"global_temp.{passing}").createOrReplaceTempView(table)
    finally:
        session.catalog.dropGlobalTempView(passing)


def open_connections(
    spark: SparkSession, connections: Sequence[Connection]
) -> tuple[dict[str, SparkSession], dict[str, str]]:
    """Live sessions by name, and the error text of every connection that failed."""
    live: dict[str, SparkSession] = {}
    dead: dict[str, str] = {}
    for connection in connections:
        session = scoped_session(spark)
        try:
            for table, df in connection.load(session).items():
                _show(df, session, table)
        except Exception as err:  # noqa: BLE001 - any failure to open is this connection's own
            dead[connection.name] = first_line(err)
        else:
            live[connection.name] = session
    return live, dead


def first_line(err: Exception) -> str:
    text = err.getMessage() if hasattr(err, "getMessage") else str(err)
    return (text or type(err).__name__).splitlines()[0]
