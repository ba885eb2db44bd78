"""Rules per closed window against whole checks over each window's rows."""

import random
from datetime import datetime, timedelta

from plumbline.model import ColumnRule
from plumbline.plans.validate import rule_report
from plumbline.streaming import jobs
from plumbline.streaming.windows import validate_windows

SCHEMA = "id long, at timestamp, kind string, size double, level int"
RULES = [
    ColumnRule("id", unique=True, not_null=True), ColumnRule("kind", unique=True, allowed=["a", "b"], null_rate=0.2),
    ColumnRule("size", outliers="iqr", distribution="normal", unique=True), ColumnRule("level", outliers="zscore", distribution="normal", range=(0, 5)),
]


def rows(day, n, rng):
    out = []
    for _ in range(n):
        at = datetime(2024, 3, 1) + timedelta(days=day, seconds=rng.randrange(86_400))
        size = rng.choice([None, float("nan"), 1.0, 2.0, rng.gauss(5, 1), rng.gauss(5, 40) if rng.random() < 0.05 else 4.0])
        out.append((rng.randrange(2 * n), at, rng.choice(["a", "b", "c", None]), size, rng.choice([1, 2, 3, 3, 3, 90 if rng.random() < 0.05 else 3])))
    return out


def test_each_window_is_judged_like_a_table(spark, tmp_path):
    rng = random.Random(6)
    days = {0: 300, 1: 2, 2: 9, 3: 500, 4: 1, 5: 40}
    data = {day: rows(day, n, rng) for day, n in days.items()}
    data[1] = [(7, data[1][0][1], "a", 3.0, 3)] * 9  # equal values only
    path = str(tmp_path)
    for some in ((0, 1), (2, 3, 4), (5,)):  # windows close in different micro-batches and runs
        for day in some:
            spark.createDataFrame(data[day], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = jobs.read_stream(spark, f"{path}/in", SCHEMA)
        validate_windows(stream, RULES, "at", "1 day", "1 hour", f"{path}/out", f"{path}/checkpoint").awaitTermination(300)
    got = {r["window_start"].day - 1: r for r in spark.read.parquet(f"{path}/out").collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for day, r in got.items():
        assert r["n_rows"] == len(data[day])
        for want in rule_report(spark.createDataFrame(data[day], SCHEMA), RULES).collect():
            expected = None if want["status"] == "ERROR" else want["violations"]
            assert r[f"{want['column']}_{want['rule']}"] == expected, (day, want)
