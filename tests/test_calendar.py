"""Calendar cadences against a walk over every minute."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.model import Check
from plumbline.plans.calendar import calendar_due, calendar_frame, expected_moments, missed_moments, parse_calendar

START, END = datetime(2023, 12, 28, 7, 13), datetime(2024, 3, 2, 5, 1)
SPECS = ["0 9 * * *", "*/5 * * * *", "17 3-9/3 * * *", "0 0 29 2 *", "30 12 1,15 * mon", "0 6 */10 jan-feb *", "5,50 23 * * 7", "0 0 * * sat-sun", "1-3 4 31 * *", "0 22 * * 5/2"]


def at(moment):
    return F.lit(f"{moment:%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz")


def walk(spec, start, end):
    c, out, now = parse_calendar(spec), [], start.replace(second=0)
    while now < end:
        by_day, by_week = now.day in c.days, now.isoweekday() % 7 in c.weekdays
        if now >= start and now.minute in c.minutes and now.hour in c.hours and now.month in c.months and ((by_day or by_week) if c.either else (by_day and by_week)):
            out.append(now)
        now += timedelta(minutes=1)
    return out


def test_fields():
    c = parse_calendar("*/15 1-3,7 * feb,DEC sun")
    assert (c.minutes, c.hours, c.months, c.weekdays, c.either) == ((0, 15, 30, 45), (1, 2, 3, 7), (2, 12), (0,), False)
    assert parse_calendar("0 0 13 * 5").either and parse_calendar("0 0 13 * fri").weekdays == (5,) and len(parse_calendar("* * * * *").weekdays) == 7


@pytest.mark.parametrize("text", ["", "garbage", "5", "* * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "* * * 13 *", "* * * * 8", "5-2 * * * *", "*/0 * * * *", "*/ * * * *", "a * * * *", "1.5 * * * *", ", * * * *", "* * * * * *"])
def test_what_is_no_calendar(text):
    with pytest.raises(ValueError):
        parse_calendar(text)


def test_checks_take_calendars_as_cadence():
    check = Check("c", "SELECT 1", every="0 9 * * mon-fri")
    assert (check.calendar, check.every_secs) == ("0 9 * * mon-fri", None)
    assert Check("c", "SELECT 1", every="5m").calendar is None
    with pytest.raises(ValueError, match="calendar"):
        Check("c", "SELECT 1", every="0 99 * * *")


def test_moments_and_missed_runs(spark):
    calendars = calendar_frame(spark, dict(zip(SPECS, SPECS, strict=True)))
    got = {}
    for r in expected_moments(calendars, at(START), at(END)).collect():
        got.setdefault(r["check"], []).append(r["expected_at"])
    want = {s: walk(s, START, END) for s in SPECS}
    assert {s: sorted(m) for s, m in got.items()} == {s: m for s, m in want.items() if m}
    rng = random.Random(3)
    runs = [(s, START + timedelta(seconds=rng.randrange(int((END - START).total_seconds())))) for s in SPECS for _ in range(rng.choice([0, 3, 200]))]
    runs += [(SPECS[0], want[SPECS[0]][3]), (SPECS[0], want[SPECS[0]][4] - timedelta(seconds=1))]
    history = spark.createDataFrame(runs, "check string, run_at timestamp_ntz")
    found = {(r["check"], r["expected_at"]): (r["ran_at"], r["missed"]) for r in missed_moments(calendars, history, at(START), at(END)).collect()}
    assert len(found) == sum(map(len, want.values()))
    for spec, moments in want.items():
        own = sorted(at for s, at in runs if s == spec)
        for moment, until in zip(moments, [*moments[1:], END], strict=True):
            first = next((x for x in own if moment <= x < until), None)
            assert found[spec, moment] == (first, first is None)


@pytest.mark.parametrize(("last", "now", "due"), [
    (None, datetime(2024, 1, 1), True), (datetime(2024, 1, 1, 0, 4, 59), datetime(2024, 1, 1, 0, 5, 1), True), (datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 1, 0, 9, 59), False),
    (datetime(2024, 1, 1, 0, 5), datetime(2024, 1, 1, 0, 10), True), (datetime(2023, 12, 31, 23, 56), datetime(2024, 1, 1), True), (datetime(2024, 1, 1, 0, 20), datetime(2024, 1, 1, 0, 10), False),
])
def test_due(spark, last, now, due):
    history = spark.createDataFrame([("c", last)] if last else [], "check string, run_at timestamp_ntz")
    assert [r["due"] for r in calendar_due(calendar_frame(spark, {"c": "*/5 * * * *"}), history, at(now)).collect()] == [due]
