"""Results as tables: append a run, read the history, write reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.commits import Log
from plumbline.plans.results import report_json, report_yaml


#: How runs that others were put together into are named.
MERGED = "merged-"


def append_results(results: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Add a run to the history, partitioned by run date so reads can prune.

    A run with a ``run_id`` is in the history once however often it is written, and a run that died half-way not at all
    (see :mod:`plumbline.functions.commits`); false means it was there. Rebalancing keeps files few, and splits a date that
    holds most of the rows.
    """
    dated = results.withColumn("run_date", F.to_date("run_at"))

    def write(folder: str) -> None:
        dated.hint("rebalance", "run_date").write.mode("overwrite").partitionBy("run_date").parquet(folder)

    return Log(results.sparkSession, path).add(run_id or f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}", write)


def _read(spark: SparkSession, log: Log, runs: Sequence[str]) -> DataFrame:
    return spark.read.option("basePath", log.root).parquet(*map(log.folder, runs)).drop("run")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The history: all runs that were written to their end."""
    log = Log(spark, path)
    runs = log.runs()
    if not runs:
        raise ValueError(f"no complete run in {path}")
    return _read(spark, log, runs)


def compact_results(spark: SparkSession, path: str, everything: bool = False) -> int:
    """Put the runs added since the last time (or ``everything``) together in few files; how many runs that were.

    Readers see the same rows before, meanwhile and after. The files that were replaced stay for readers that began before;
    :func:`clean_results` deletes them.
    """
    log = Log(spark, path)
    small = [r for r in log.runs() if everything or not r.startswith(MERGED)]
    if len(small) < 2:
        return 0
    rows = _read(spark, log, small)

    def write(folder: str) -> None:
        rows.hint("rebalance", "run_date").write.mode("overwrite").partitionBy("run_date").parquet(folder)

    log.add(f"{MERGED}{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}", write, small)
    return len(small)


def clean_results(spark: SparkSession, path: str) -> None:
    Log(spark, path).clean()


def write_json(results: DataFrame, path: str) -> None:
    report_json(results).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_yaml(results: DataFrame, path: str) -> None:
    report_yaml(results).select(F.col("yaml").alias("value")).write.mode("overwrite").text(path)
