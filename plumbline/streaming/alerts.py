"""Sustained alerts over a stream of results, with streaks in the state store.

State is one small row per check: when its streak began, and the runs that wait for the watermark. Runs are taken in the
order of ``run_at`` whatever order they arrive in, as long as they arrive within the delay. The state belongs to the
checkpoint: Spark writes, cleans and recovers it with the query, and nothing else is kept between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.model import FAILING
from plumbline.plans.alerts import raise_events
from plumbline.streaming.jobs import AVAILABLE_NOW

_STATE = "onset long, ats array<long>, statuses array<string>, details array<string>"
_MARKED = "check string, at long, status string, detail string, failing boolean, since long, recovered boolean"


def _follow(onset: int | None, runs: list[tuple]) -> tuple[int | None, list[tuple]]:
    """Marks of runs in order, and when the streak that is open after them began."""
    out = []
    for at, status, detail in runs:
        failing = status in FAILING
        recovered = not failing and onset is not None
        onset = (at if onset is None else onset) if failing else None
        out.append((at, status, detail, failing, onset, recovered))
    return onset, out


def _step(waits: bool):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        onset, waiting = None, []
        if state.exists:
            onset, *held = state.get
            waiting = list(zip(*(x or [] for x in held), strict=True))
        for frame in frames:
            waiting += list(zip(frame["at"].tolist(), frame["status"].tolist(), frame["detail"].tolist(), strict=True))
        waiting.sort(key=lambda r: (r[0], r[1] or "", r[2] or ""))
        passed = state.getCurrentWatermarkMs() * 1000 if waits else None
        ready = [r for r in waiting if passed is None or r[0] <= passed]
        waiting = waiting[len(ready) :]
        onset, marks = _follow(onset, ready)
        if onset is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((onset, [r[0] for r in waiting], [r[1] for r in waiting], [r[2] for r in waiting]))
            if waiting:
                state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs() + 1))
        if marks:
            out = pd.DataFrame(marks, columns=["at", "status", "detail", "failing", "since", "recovered"])
            out.insert(0, "check", key[0])
            yield out.astype({"since": "Int64"})

    return step


def stream_streaks(results: DataFrame, delay: str | None = None) -> DataFrame:
    """Streaming results as :func:`plumbline.plans.alerts.streaks` marks a whole history.

    With a ``delay`` a run is marked once the watermark has passed it, in order of ``run_at``; runs later than that are
    dropped. Without, runs are marked at once, in order within each micro-batch.
    """
    kind = results.schema["run_at"].dataType
    runs = results.select("check", "status", "detail", F.col("run_at").cast("timestamp").alias("_at"))
    if delay is not None:
        runs = runs.withWatermark("_at", delay)
    timeout = GroupStateTimeout.EventTimeTimeout if delay is not None else GroupStateTimeout.NoTimeout
    numbered = runs.withColumn("at", F.unix_micros("_at"))
    marked = numbered.groupBy("check").applyInPandasWithState(_step(delay is not None), _MARKED, _STATE, "append", timeout)
    return marked.select("check", F.timestamp_micros("at").cast(kind).alias("run_at"), "status", "detail", "failing", F.timestamp_micros("since").cast(kind).alias("since"), "recovered")


def sustained_alerts(
    results: DataFrame, suite: DataFrame, path: str, checkpoint: str, delay: str | None = None, trigger: Mapping[str, Any] = AVAILABLE_NOW
) -> StreamingQuery:
    """Write alerts and recoveries as results stream in to ``path/events``, each once; for ``delay`` see :func:`stream_streaks`."""
    events = raise_events(stream_streaks(results, delay), suite)
    return events.writeStream.outputMode("append").format("parquet").option("path", f"{path}/events").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def open_streaks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``check`` and ``onset`` of the streaks that are open after the last micro-batch, read from the state itself."""
    state = spark.read.format("statestore").load(checkpoint)
    onset = F.col("value.groupState.onset") if "groupState" in state.schema["value"].dataType.names else F.col("value.onset")
    return state.select(F.col("key.check").alias("check"), F.timestamp_micros(onset).alias("onset")).where("onset IS NOT NULL")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/events")
