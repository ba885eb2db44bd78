"""Run a suite: every check isolated, results in suite order.

Checks over the same query share one pass: their counts, first rows and rule
measures are one aggregate. Groups run side by side on a few driver threads.
Only one row per check, and at most ten sample rows of a failing one, come back.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.lineage import discard, materialise
from plumbline.functions.normalise import unsupported_column
from plumbline.functions.text import debug_list, quote
from plumbline.functions.time import register_functions, utc
from plumbline.model import ERROR, FAIL, WARN, Check, Suite
from plumbline.plans.profiles import Profile, source_of
from plumbline.plans.rules import compile_rules, find_fences, measure, missing_columns
from plumbline.plans.thresholds import add_rows, first_row, needs, sample_array, tier_verdict
from plumbline.plans.validate import sample_json, verdict
from plumbline.sources.connections import first_line, open_connections, query_reader

RESULT_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("check", T.StringType(), False),
    T.StructField("connection", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("detail", T.StringType(), True),
    T.StructField("sample", T.ArrayType(T.StringType()), False),
    T.StructField("run_at", T.TimestampType(), False),
])


@dataclass
class Outcome:
    status: str
    detail: str
    sample: list[str] = field(default_factory=list)


@dataclass
class _Job:
    """Checks that read the same result."""

    session: SparkSession
    df: DataFrame
    checks: list[tuple[int, Check]]
    timeout: int | None
    written: bool = False
    """Whether the source may change between passes, so that its rows are fetched once."""
    store: str | None = None
    """Where partial aggregates of its tables are kept, if they are."""
    options: Mapping[str, Any] | None = None


class QueryTimeout(Exception):
    pass


def suite_frame(spark: SparkSession, suite: Suite) -> DataFrame:
    """The suite itself as rows: name, connection, query, tiers, cadence, routing."""
    schema = (
        "ord int, check string, connection string, query string, conditions array<string>, "
        "every_secs bigint, sustained_secs bigint, on_fail string"
    )
    rows = [
        (i, c.name, c.on, c.sql, list(c.tiers), c.every_secs, c.sustained_secs, c.on_fail)
        for i, c in enumerate(suite.resolved())
    ]
    return spark.createDataFrame(rows, schema)


def resolve(check: Check, session: SparkSession, options: Mapping[str, Any] | None = None) -> DataFrame:
    """The check's result as a DataFrame: analysed, not run. With ``options`` a database runs the SQL."""
    if options and check.sql is not None:
        return session.read.format("jdbc").options(**query_reader(session, options, check.sql)).load()
    return check.query(session) if callable(check.query) else session.sql(check.sql)


def group_plan(df: DataFrame, checks: Sequence[tuple[int, Check]], as_of: datetime | None = None) -> DataFrame:
    """One row per check (``ord, status, detail, broken``) from one pass over ``df``.

    ``broken`` lists the positions of the violated column rules.
    """
    nothing = F.array().cast("array<int>").alias("broken")
    problem = unsupported_column(df.schema)
    if problem:
        rows = [F.struct(F.lit(i).alias("ord"), F.lit(ERROR).alias("status"), F.lit(problem).alias("detail"), nothing) for i, _ in checks]
        return df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    measures = {i: compile_rules(c.validate, df.schema, f"k{i}_") for i, c in checks if c.validate is not None}
    wanted = [needs(c) for _, c in checks]
    order_by = next((c.order_by for _, c in checks if c.order_by), None)
    extra: list[Column] = [first_row(df, order_by).alias("row")] if any(row for row, _ in wanted) else []
    every = [m for ms in measures.values() for m in ms]
    ctx = measure(df, every, find_fences(df, every), extra)
    ctx = add_rows(ctx, df, order_by, any(sample for _, sample in wanted), as_of)
    lines = []
    for i, check in checks:
        if check.validate is not None:
            status, detail, broken = verdict(check.validate, measures[i], missing_columns(check.validate, df.schema, check.name))
        else:
            (status, detail), broken = tier_verdict(ctx, check), nothing
        lines.append(F.struct(F.lit(i).alias("ord"), status.alias("status"), detail.alias("detail"), broken.alias("broken")))
    return ctx.select(F.inline(F.array(*lines)))


def check_sample(df: DataFrame, check: Check, status: str, broken: Sequence[int]) -> DataFrame | None:
    """The sample rows a finished check should carry, if any."""
    if check.validate is not None:
        return sample_json(df, check.validate, check.order_by, only=broken) if status == FAIL else None
    tier = {FAIL: check.fail, WARN: check.warn}.get(status)
    return sample_array(df, tier.sample, check.order_by) if tier and tier.sample else None


def _cancel_after(spark: SparkSession, group: str, seconds: float, done: threading.Event, fired: threading.Event) -> None:
    """Cancel a job group at the deadline, again and again until its thread ends."""
    if done.wait(seconds):
        return
    fired.set()
    while not done.wait(0.2):
        spark.sparkContext.cancelJobGroup(group)


def with_deadline(spark: SparkSession, seconds: float | None, work: Callable[[], list[Row]]) -> list[Row]:
    """Run Spark work of this thread; its jobs are really stopped at the deadline, if there is one."""
    if seconds is None:
        return work()
    group, done, fired = f"plumbline-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    spark.sparkContext.setJobGroup(group, "plumbline check", interruptOnCancel=True)
    watch = threading.Thread(target=_cancel_after, args=(spark, group, seconds, done, fired), daemon=True)
    watch.start()
    try:
        return work()
    except Exception as err:
        if fired.is_set():
            raise QueryTimeout(f"query exceeded timeout ({seconds:g}s)") from err
        raise
    finally:
        done.set()


def _from_profile(job: _Job) -> dict[int, Outcome]:
    """Outcomes of the checks that stored partial aggregates can answer."""
    ruled = [(i, c) for i, c in job.checks if c.validate is not None and not c.materialise]
    source = source_of(job.df) if job.store and ruled and not job.written and not unsupported_column(job.df.schema) else None
    out = {}
    for i, check in ruled if source else []:
        profile = Profile(job.session, job.store, lambda session, check=check: resolve(check, session, job.options), source, check.validate, check.name, check.order_by)
        got = profile.evaluate()
        out[i] = Outcome(got.status, got.detail, got.sample)
    return out


def _run_job(job: _Job, as_of: datetime | None) -> dict[int, Outcome]:
    by_ord = dict(job.checks)

    def work() -> dict[int, Outcome]:
        known = _from_profile(job)
        rest = [pair for pair in job.checks if pair[0] not in known]
        return {**known, **(scan(rest) if rest else {})}

    def scan(checks: list[tuple[int, Check]]) -> dict[int, Outcome]:
        df, path = materialise(job.df) if job.written or any(c.materialise for c in by_ord.values()) else (job.df, None)
        try:
            out = {}
            for r in group_plan(df, checks, as_of).collect():
                sample = check_sample(df, by_ord[r["ord"]], r["status"], r["broken"])
                out[r["ord"]] = Outcome(r["status"], r["detail"], list(sample.first()["sample"]) if sample is not None else [])
            return out
        finally:
            if path is not None:
                discard(job.session, path)

    try:
        return with_deadline(job.session, job.timeout, work)
    except Exception as err:  # noqa: BLE001 - a failing or slow check must not take the others down
        if len(job.checks) == 1:
            return {i: Outcome(ERROR, first_line(err)) for i in by_ord}
        out: dict[int, Outcome] = {}
        for pair in job.checks:  # each by itself, with its own deadline
            out.update(_run_job(_Job(job.session, job.df, [pair], job.timeout, job.written, job.store, job.options), as_of))
        return out


def run_checks(
    spark: SparkSession, suite: Suite, as_of: datetime | None = None, threads: int = 8, store: str | None = None
) -> list[tuple[Check, Outcome]]:
    """Every check of the suite with its outcome, in suite order.

    With a ``store`` (a folder), column rules over Parquet tables are judged by partial aggregates kept there, and only
    files that no earlier run has seen are scanned (see :mod:`plumbline.plans.profiles`).

    Opening connections and analysing queries happen here on the driver; only
    the groups that are left to run start Spark jobs.
    """
    live, dead = open_connections(spark, suite.connections)
    declared = [c.name for c in suite.connections]
    options = {c.name: c.options for c in suite.connections}
    changing = {c.name for c in suite.connections if c.live}
    for session in live.values():
        register_functions(session, as_of)
    checks = suite.resolved()
    results: dict[int, Outcome] = {}
    jobs: dict[tuple, _Job] = {}
    for i, check in enumerate(checks):
        if check.on in dead:
            results[i] = Outcome(ERROR, f"connection {quote(check.on)} unavailable: {dead[check.on]}")
            continue
        if check.on not in live:
            text = f"check {quote(check.name)} references unknown connection {quote(check.on)}; declared connections: {debug_list(declared)}"
            results[i] = Outcome(ERROR, text)
            continue
        key = (check.on, check.sql or check.query, check.timeout_secs, tuple(check.order_by or ()))
        if key in jobs:
            jobs[key].checks.append((i, check))
            continue
        try:
            df = resolve(check, live[check.on], options[check.on])
        except Exception as err:  # noqa: BLE001 - e.g. a missing table
            results[i] = Outcome(ERROR, first_line(err))
        else:
            jobs[key] = _Job(live[check.on], df, [(i, check)], check.timeout_secs, check.on in changing, store, options[check.on])
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(jobs) or 1))) as pool:
        for out in pool.map(lambda job: _run_job(job, as_of), jobs.values()):
            results.update(out)
    return [(check, results[i]) for i, check in enumerate(checks)]


def run_suite(
    spark: SparkSession, suite: Suite, as_of: datetime | None = None, threads: int = 8, store: str | None = None
) -> DataFrame:
    """All results, one row per check, in suite order (column ``ord``); for ``store`` see :func:`run_checks`."""
    run_at = utc(as_of or datetime.now(UTC))
    rows = [
        (i, check.name, check.on, out.status, out.detail, out.sample, run_at)
        for i, (check, out) in enumerate(run_checks(spark, suite, as_of, threads, store))
    ]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def run_check(spark: SparkSession, suite: Suite, name: str, as_of: datetime | None = None) -> DataFrame:
    """The result of one check of a suite, by name."""
    found = [c for c in suite.resolved() if c.name == name]
    if not found:
        raise ValueError(f"check {quote(name)} not found; available: {debug_list([c.name for c in suite.resolved()])}")
    return run_suite(spark, Suite(suite.connections, found), as_of)
