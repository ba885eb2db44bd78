"""Failure streaks and alerts, derived from the history of results.

A history has ``check, run_at, status`` (and ``detail``). One check may hold
most of the rows, so no window here spans a whole check: rows are windowed
inside time buckets, each bucket is folded to one summary row, and only those
summaries are chained along time. What a bucket needs from the past is then
joined back to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.time import seconds_between
from plumbline.plans.results import is_failing

RECOVERED = "RECOVERED"


def should_notify(failing: Column, sustained_secs: Column, since: Column, now: Column) -> Column:
    """Failing, and for at least the sustained window if there is one.

    ``since`` and ``now`` are in seconds; an unknown ``since`` holds back.
    """
    held = F.coalesce(now - since >= sustained_secs, F.lit(False))
    return failing & F.when(sustained_secs.isNull(), True).otherwise(held)


def _bucket_chain(local: DataFrame, opened: DataFrame | None) -> DataFrame:
    """Per check and bucket: onset of the streak that is open when it begins."""
    folded = local.groupBy("check", "bucket").agg(
        F.max_by("failing", "run_at").alias("ends_failing"),
        F.bool_or(~F.col("failing")).alias("has_healthy"),
        F.max(F.when(F.col("local_start"), F.col("run_at"))).alias("last_start"),
    )
    if opened is None:
        folded = folded.withColumn("before", F.lit(None).cast(local.schema["run_at"].dataType))
    else:
        folded = folded.join(opened.select("check", F.col("onset").alias("before")), "check", "left")
    along = Window.partitionBy("check").orderBy("bucket")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Buckets without a healthy run continue the streak of the bucket before.
    chained = folded.withColumn("run", F.sum(F.col("has_healthy").cast("int")).over(so_far))
    within = Window.partitionBy("check", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onset = F.min(F.when(F.col("ends_failing"), F.col("last_start"))).over(within)
    inherited = F.when(F.col("run") == 0, F.col("before"))
    linked = chained.withColumn("open_onset", F.coalesce(inherited, onset))
    carried = F.when(F.row_number().over(along) == 1, F.col("before")).otherwise(F.lag("open_onset").over(along))
    return linked.select("check", "bucket", carried.alias("carried"))


def streaks(history: DataFrame, bucket: str = "day", opened: DataFrame | None = None) -> DataFrame:
    """Adds ``failing``, ``since`` (onset of the current streak) and ``recovered``.

    ``since`` is kept through repeated failures and NULL on healthy runs.
    ``recovered`` marks the first healthy run after a streak. ``opened``
    (``check, onset``) gives streaks already open before the history begins.
    """
    rows = history.withColumn("failing", is_failing()).withColumn("bucket", F.date_trunc(bucket, "run_at"))
    inside = Window.partitionBy("check", "bucket").orderBy("run_at")
    local = rows.withColumn("prev", F.lag("failing").over(inside)).withColumn(
        "local_start", F.col("failing") & ~F.coalesce("prev", F.lit(False))
    )
    joined = local.join(_bucket_chain(local, opened), ["check", "bucket"], "left")
    starts = F.col("local_start") & (F.col("prev").isNotNull() | F.col("carried").isNull())
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onset = F.coalesce(F.max(F.when(starts, F.col("run_at"))).over(so_far), F.col("carried"))
    was_failing = F.coalesce(F.col("prev"), F.col("carried").isNotNull())
    return joined.select(
        *history.columns, "failing",
        F.when(F.col("failing"), onset).alias("since"),
        (~F.col("failing") & was_failing).alias("recovered"),
    )


def still_open(marked: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """Streaks open after a history: ``check, onset``, to continue from later.

    ``marked`` comes from :func:`streaks`; checks without a run in it keep the
    streak they had.
    """
    last = F.max_by(F.struct("failing", "since"), F.col("run_at")).alias("last")
    ended = marked.groupBy("check").agg(last).select("check", F.lit(True).alias("ran"), F.col("last.since").alias("onset_now"))
    if opened is None:
        return ended.where("onset_now IS NOT NULL").select("check", F.col("onset_now").alias("onset"))
    both = opened.join(ended, "check", "full_outer")
    onset = F.when(F.col("ran"), F.col("onset_now")).otherwise(F.col("onset"))
    return both.select("check", onset.alias("onset")).where("onset IS NOT NULL")


def raise_events(marked: DataFrame, suite: DataFrame) -> DataFrame:
    """Alerts and recoveries among runs marked by :func:`streaks`."""
    gated = marked.join(suite.select("check", "sustained_secs", "on_fail"), "check", "left")
    alerting = should_notify(
        F.col("failing"), F.col("sustained_secs"), F.lit(0), seconds_between(F.col("since"), F.col("run_at"))
    )
    return gated.where(alerting | F.col("recovered")).select(
        "check", "run_at", F.when(F.col("recovered"), RECOVERED).otherwise(F.col("status")).alias("status"), "detail",
        "since", "on_fail",
    )


def alert_events(history: DataFrame, suite: DataFrame, bucket: str = "day") -> DataFrame:
    """Every event a run of checks raises: alerts while failing, and recoveries.

    ``suite`` gives ``check, sustained_secs, on_fail`` (at most a row per check).
    A failing run alerts once its streak has lasted the sustained window; a
    recovery is reported even when the streak never alerted.
    """
    return raise_events(streaks(history, bucket), suite)


def route(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Each event with its targets: the one it names, or all when it names none."""
    named = targets.select(F.col("target").alias("_to"), "target")
    every = targets.select(F.lit(None).cast("string").alias("_to"), "target")
    routes = named.unionByName(every)
    return events.join(routes, events["on_fail"].eqNullSafe(routes["_to"])).drop("_to")


def payload(events: DataFrame) -> DataFrame:
    """Adds the message body as JSON: text, check, status, detail."""
    mark = F.when(F.col("status") == RECOVERED, ":white_check_mark:").otherwise(":red_circle:")
    text = F.concat(mark, F.lit(" "), F.col("check"), F.lit(" "), F.col("status"), F.lit(": "), F.col("detail"))
    return events.withColumn("payload", F.to_json(F.struct(text.alias("text"), "check", "status", "detail")))


def cadence(suite: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """Per check of the suite with an interval: last run, whether it is due, and how late it is.

    Checks that run by the calendar are judged by :mod:`plumbline.plans.calendar`.
    """
    last = history.groupBy("check").agg(F.max("run_at").alias("last_run"))
    idle = seconds_between(F.col("last_run"), as_of)
    late = F.greatest(idle - F.col("every_secs"), F.lit(0.0))
    return suite.where("every_secs IS NOT NULL").select("check", "every_secs").join(last, "check", "left").select(
        "check", "every_secs", "last_run",
        F.coalesce(idle >= F.col("every_secs"), F.lit(True)).alias("due"), late.alias("overdue_secs"),
    )
