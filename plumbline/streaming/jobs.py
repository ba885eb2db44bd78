"""Checks over a stream of rows.

Each function takes a streaming DataFrame and returns one, or starts a query.
Event times without a zone are read as timestamps first, because watermarks
need them. Functions that start a query take a ``trigger``: the arguments of
Spark's own, by default everything that is available now; ``{"processingTime":
"1 minute"}`` runs as a service until it is stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.text import column
from plumbline.model import ColumnRule, Suite
from plumbline.plans.rules import Measure, compile_rules, missing_columns
from plumbline.plans.suite import run_suite
from plumbline.plans.validate import validate
from plumbline.sources.connections import Connection, frame_connection

#: Partitions that one key of a stream is spread over when it is joined.
SALTS = 16


def read_stream(
    spark: SparkSession, path: str, schema: str, time: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as they arrive; ``path`` is a folder or a glob.

    ``files_per_batch`` bounds a micro-batch when a long backlog is waiting.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp")) if time else stream


#: The default trigger: all that is available now, then stop.
AVAILABLE_NOW: Mapping[str, Any] = {"availableNow": True}


def write_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: Mapping[str, Any] = AVAILABLE_NOW
) -> StreamingQuery:
    """Run a stream into a Parquet table.

    Windows reach an ``append`` table once the watermark has passed them; see
    :func:`write_latest` for those still open.
    """
    return (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def write_latest(stream: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE_NOW) -> StreamingQuery:
    """Record, per micro-batch, every window that changed in it, closed or not.

    The newest ``batch`` of a window holds its latest state.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(record)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


@contextmanager
def _held(batch: DataFrame) -> Iterator[DataFrame]:
    """The micro-batch kept while several passes read it; lost parts are read again from the source."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def validate_stream(
    stream: DataFrame, rules: Sequence[ColumnRule], check: str, path: str, checkpoint: str, order_by: Sequence[str] | None = None,
    trigger: Mapping[str, Any] = AVAILABLE_NOW,
) -> StreamingQuery:
    """Validate each micro-batch and append one result row per batch.

    A batch replayed after a failure overwrites its own ``batch`` partition, so
    every batch is recorded once.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        with _held(batch) as rows:
            result = validate(rows, rules, check, order_by).withColumn("run_at", F.current_timestamp())
            result.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def watch_suite(
    stream: DataFrame, table: str, suite: Callable[[Connection], Suite], path: str, checkpoint: str, as_of: datetime | None = None,
    trigger: Mapping[str, Any] = AVAILABLE_NOW,
) -> StreamingQuery:
    """Run a whole suite on each micro-batch and append its results.

    ``suite`` receives a connection in which the batch is a table; it may add
    others, say for the static side of a join.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        with _held(batch) as rows:
            results = run_suite(batch.sparkSession, suite(frame_connection("batch", {table: rows})), as_of)
            results.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def window_rules(stream: DataFrame, rules: Sequence[ColumnRule], time: str, width: str, delay: str) -> DataFrame:
    """Violations of rules per tumbling event-time window: counts of offending rows, nulls counted where their share is too large.

    Rules that need all of a window's values at once (``unique``, ``outliers``,
    ``distribution``; see :func:`plumbline.streaming.windows.validate_windows`) and
    columns the stream does not have raise ``ValueError``.
    """
    missing = missing_columns(rules, stream.schema, "window")
    if missing:
        raise ValueError("; ".join(missing.values()))
    measures = compile_rules(rules, stream.schema)
    refused = [f"{m.column}: {m.rule}" for m in measures if m.rule in ("unique", "outliers", "distribution")]
    if refused:
        raise ValueError(f"rules that cannot be judged per window: {', '.join(refused)}")

    def violations(m: Measure) -> Column:
        if m.rule != "null_rate":
            return F.count_if(m.predicate())
        nulls = m.aggregates()[0]
        return F.when(nulls / F.count(F.lit(1)) > F.lit(float(m.param)), nulls).otherwise(F.lit(0)).cast("bigint")

    counts = [violations(m).alias(f"{m.column}_{m.rule}") for m in measures]
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"))
    return windowed.agg(F.count(F.lit(1)).alias("n_rows"), *counts).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_rows",
        *[f"{m.column}_{m.rule}" for m in measures],
    )


def sliding_volume(stream: DataFrame, time: str, width: str, slide: str, delay: str) -> DataFrame:
    """Row counts per sliding window."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_rows")


def silent_gaps(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Activity sessions per key; a session's end is where the key fell silent.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    in the session: sessions are then merged within each task before the
    shuffle, so a busy key sends few rows.
    """
    sessions = stream.withWatermark(time, delay).groupBy(F.col(key), F.session_window(time, gap).alias("w"))
    return sessions.agg(F.count(F.lit(1)).alias("n_rows")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_rows"
    )


def drop_repeats(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First reading per key combination within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_orphans(stream: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Stream rows whose parent is not in a static table; a NULL key has none.

    Adaptive execution does not split the joins of a stream, so rows with a NULL
    key skip the join, and both sides spread each key over ``SALTS`` partitions:
    rows by a hash of their content, parents once for each. Spark's estimate does
    not know that these are ``SALTS`` times the parents, so the join is asked to
    sort and merge: the driver would not hold a broadcast that seems small enough.
    """
    spread = F.pmod(F.xxhash64(*map(column, stream.columns)), F.lit(SALTS))
    keyed = stream.where(column(key).isNotNull()).withColumn("_salt", spread.cast("int"))
    known = parents.select(column(parent_key).alias("_key")).where("_key IS NOT NULL").distinct()
    known = known.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS))))).hint("merge")
    lost = keyed.join(known, (keyed[key] == known["_key"]) & (keyed["_salt"] == known["_salt"]), "left_anti").drop("_salt")
    return lost.unionByName(stream.where(column(key).isNull()))
