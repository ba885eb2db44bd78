"""Streaks and alerts against a plain step-by-step run over the same history."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions.lineage import fresh_dir
from plumbline.plans import alerts
from plumbline.streaming import jobs
from plumbline.streaming.alerts import open_streaks, read_events, sustained_alerts

START = datetime(2024, 1, 1)
SCHEMA = "check string, run_at timestamp_ntz, status string, detail string"
SUITE = "check string, sustained_secs bigint, on_fail string"


def step_by_step(rows, sustained):
    """What a watcher that sees one result at a time would do."""
    since, marks, events = {}, {}, []
    for check, at, status, detail in sorted(rows, key=lambda r: r[1]):
        if status in ("FAIL", "ERROR"):
            onset = since.setdefault(check, at)
            marks[check, at] = (onset, False)
            window = sustained.get(check)
            if window is None or (at - onset).total_seconds() >= window:
                events.append((check, at, status))
        else:
            marks[check, at] = (None, check in since)
            if since.pop(check, None) is not None:
                events.append((check, at, "RECOVERED"))
    return marks, sorted(events)


def history(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for check, share in (("steady", 0.05), ("flaky", 0.5), ("down", 0.98), ("always", 1.0)):
        at = START
        for _ in range(n if check != "flaky" else 3 * n):
            at += timedelta(minutes=rng.choice([1, 7, 60, 600]))
            bad = rng.random() < share
            rows.append((check, at, rng.choice(["FAIL", "ERROR"]) if bad else rng.choice(["PASS", "WARN"]), "d"))
    return rows


SUSTAINED = {"flaky": 300, "down": 86_400}
SUITE_ROWS = [("steady", None, None), ("flaky", 300, "ops"), ("down", 86_400, None), ("always", None, "ops")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bucket", ["hour", "day", "year"])
def test_streaks_and_events(spark, seed, bucket):
    rows = history(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    marks, events = step_by_step(rows, SUSTAINED)
    got = {(r["check"], r["run_at"]): (r["since"], r["recovered"]) for r in alerts.streaks(df, bucket).collect()}
    assert got == marks
    raised = alerts.alert_events(df, spark.createDataFrame(SUITE_ROWS, SUITE), bucket).collect()
    assert sorted((r["check"], r["run_at"], r["status"]) for r in raised) == events


def test_streaks_continue_from_open_ones(spark):
    rows = sorted(history(3, 150), key=lambda r: r[1])
    marks, _ = step_by_step(rows, SUSTAINED)
    opened, got = None, {}
    for lo, hi in ((0, 100), (100, 350), (350, len(rows))):
        marked = alerts.streaks(spark.createDataFrame(rows[lo:hi], SCHEMA), "day", opened)
        got.update({(r["check"], r["run_at"]): (r["since"], r["recovered"]) for r in marked.collect()})
        left = [tuple(r) for r in alerts.still_open(marked, opened).collect()]
        opened = spark.createDataFrame(left, "check string, onset timestamp_ntz")
    assert got == marks


def test_onset_is_kept_and_cleared(spark):
    at = [START + timedelta(seconds=s) for s in (1000, 2000, 2500, 3000)]
    df = spark.createDataFrame([("c", t, s, "d") for t, s in zip(at, ["FAIL", "ERROR", "PASS", "FAIL"], strict=True)], SCHEMA)
    rows = alerts.streaks(df).orderBy("run_at").collect()
    assert [r["since"] for r in rows] == [at[0], at[0], None, at[3]]
    assert [r["recovered"] for r in rows] == [False, False, True, False]


@pytest.mark.parametrize(
    "failing, window, since, now, expected",
    [
        (True, 300, 1000, 1299, False), (True, 300, 1000, 1300, True), (True, 300, 1000, 1600, True), (True, 300, None, 1600, False),
        (False, 300, 1000, 1600, False), (True, None, None, 5, True), (False, None, 1, 5, False),
    ],
)
def test_notify_gate(spark, failing, window, since, now, expected):
    df = spark.createDataFrame([(failing, window, since, now)], "f boolean, w bigint, s bigint, n bigint")
    assert df.select(alerts.should_notify(F.col("f"), F.col("w"), F.col("s"), F.col("n")).alias("x")).first()["x"] is expected


def test_routing_and_payload(spark):
    events = spark.createDataFrame(
        [("a", "FAIL", "3 row(s)", "ops"), ("b", "RECOVERED", "1 row(s)", None), ("c", "FAIL", "x", "nobody")],
        "check string, status string, detail string, on_fail string",
    )
    targets = spark.createDataFrame([("ops",), ("audit",)], "target string")
    sent = sorted((r["check"], r["target"]) for r in alerts.route(events, targets).collect())
    assert sent == [("a", "ops"), ("b", "audit"), ("b", "ops")]
    bodies = {r["check"]: r["payload"] for r in alerts.payload(events).collect()}
    assert bodies["a"] == '{"text":":red_circle: a FAIL: 3 row(s)","check":"a","status":"FAIL","detail":"3 row(s)"}'
    assert bodies["b"].startswith('{"text":":white_check_mark: b RECOVERED: 1 row(s)"')


def test_cadence(spark):
    suite = spark.createDataFrame([("a", 60), ("b", 60), ("c", 60)], "check string, every_secs bigint")
    runs = [("a", START), ("a", START - timedelta(hours=1)), ("b", START - timedelta(seconds=1))]
    df = spark.createDataFrame(runs, "check string, run_at timestamp_ntz")
    now = F.lit("2024-01-01 00:00:59").cast("timestamp_ntz")
    got = {r["check"]: (r["due"], r["overdue_secs"]) for r in alerts.cadence(suite, df, now).collect()}
    assert got == {"a": (False, 0.0), "b": (True, 0.0), "c": (True, 0.0)}


def test_stream_over_several_batches(spark):
    rows = sorted(history(4, 120), key=lambda r: r[1])
    path = fresh_dir(spark, "test-alerts")
    suite = spark.createDataFrame(SUITE_ROWS, SUITE)
    for lo, hi in ((0, 150), (150, 151), (151, len(rows))):
        spark.createDataFrame(rows[lo:hi], SCHEMA).write.mode("append").parquet(f"{path}/in")
        stream = jobs.read_stream(spark, f"{path}/in", SCHEMA)
        sustained_alerts(stream, suite, f"{path}/out", f"{path}/checkpoint").awaitTermination(120)
    got = sorted((r["check"], r["run_at"], r["status"]) for r in read_events(spark, f"{path}/out").collect())
    assert got == step_by_step(rows, SUSTAINED)[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_that_arrive_out_of_order_within_the_delay_are_taken_in_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(check, START + timedelta(minutes=10 * k + shift), rng.choice(["PASS", "FAIL", "FAIL", "ERROR"]), "d") for k in range(60) for shift, check in enumerate("ab")]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.randrange(50)))  # nothing is overtaken by more than 50 minutes
    rows += [("end", START + timedelta(days=2), "FAIL", "d")]
    suite = spark.createDataFrame([("a", 1200, None), ("b", None, "ops"), ("end", None, None)], SUITE)
    path = str(tmp_path)
    for lo, hi in ((0, 37), (37, 38), (38, 90), (90, len(rows))):
        spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = jobs.read_stream(spark, f"{path}/in", SCHEMA)
        sustained_alerts(stream, suite, f"{path}/out", f"{path}/checkpoint", delay="1 hour").awaitTermination(200)
    got = sorted((r["check"], r["run_at"], r["status"]) for r in read_events(spark, f"{path}/out").collect())
    want = step_by_step(rows[:-1], {"a": 1200, "b": None})[1]
    assert got == want and len(want) > 40
    last = {c: max((r for r in rows[:-1] if r[0] == c), key=lambda r: r[1]) for c in "ab"}
    assert {r["check"] for r in open_streaks(spark, f"{path}/checkpoint").collect()} == {c for c, r in last.items() if r[2] != "PASS"}
