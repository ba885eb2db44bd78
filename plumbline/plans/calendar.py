"""Calendar cadences: minutes, hours, days, months and weekdays at which checks are expected, in UTC.

A cadence's five fields are small sets; expected moments, what is due and what was missed are columns and joins over them.
Runs meet expected moments by check and day, so a check with most of the history is spread over its days.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import quote

# The fields of a cadence in order, with their bounds and names.
FIELDS = (("minutes", 0, 59, ()), ("hours", 0, 23, ()), ("days", 1, 31, ()), ("months", 1, 12, "jan feb mar apr may jun jul aug sep oct nov dec".split()), ("weekdays", 0, 7, "sun mon tue wed thu fri sat".split()))
SCHEMA = "check string, minutes array<int>, hours array<int>, days array<int>, months array<int>, weekdays array<int>, either boolean"


@dataclass(frozen=True)
class Calendar:
    """``either``: a day counts if its number or its weekday is named, as both fields name some."""

    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    months: tuple[int, ...]
    weekdays: tuple[int, ...]
    either: bool


def _number(text: str, low: int, high: int, names: Iterable[str]) -> int:
    names = list(names)
    if text.lower()[:3] in names and text.isalpha():
        return low + names.index(text.lower()[:3])
    if not text.isascii() or not text.isdigit() or not low <= int(text) <= high:
        raise ValueError(f"{quote(text)} is not between {low} and {high}")
    return int(text)


def _values(field: str, low: int, high: int, names: Iterable[str]) -> set[int]:
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        first, dash, last = span.partition("-")
        if span == "*":
            a, b = low, high
        else:
            a = _number(first, low, high, names)
            b = _number(last, low, high, names) if dash else high if step else a
            b = 7 if dash and high == 7 and b == 0 else b  # a week may end on Sunday
        if a > b or (step and not (step.isascii() and step.isdigit() and int(step) > 0)) or part.endswith("/"):
            raise ValueError(f"{quote(part)} is not a range")
        out.update(range(a, b + 1, int(step) if step else 1))
    return out


def parse_calendar(text: str) -> Calendar:
    """``minute hour day month weekday``: ``*``, numbers, names, ``a-b``, lists, and steps ``/n``; Sunday is 0 or 7."""
    parts = text.split()
    if len(parts) != len(FIELDS):
        raise ValueError(f"a calendar has five fields, got {quote(text)}")
    try:
        sets = [_values(part, low, high, names) for part, (_, low, high, names) in zip(parts, FIELDS, strict=True)]
    except ValueError as err:
        raise ValueError(f"calendar {quote(text)}: {err}") from None
    sets[4] = {d % 7 for d in sets[4]}
    return Calendar(*(tuple(sorted(s)) for s in sets), either=not parts[2].startswith("*") and not parts[4].startswith("*"))


def calendar_frame(spark: SparkSession, calendars: dict[str, str]) -> DataFrame:
    """Checks with the fields of their cadences."""
    rows = []
    for check, text in calendars.items():
        c = parse_calendar(text)
        rows.append((check, list(c.minutes), list(c.hours), list(c.days), list(c.months), list(c.weekdays), c.either))
    return spark.createDataFrame(rows, SCHEMA)


def _named(day: Column) -> Column:
    by_number, by_weekday = F.array_contains("days", F.dayofmonth(day)), F.array_contains("weekdays", F.dayofweek(day) - 1)
    return F.array_contains("months", F.month(day)) & F.when(F.col("either"), by_number | by_weekday).otherwise(by_number & by_weekday)


def _moment(day: Column, hour: Column, minute: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute)


def expected_moments(calendars: DataFrame, start: Column, end: Column) -> DataFrame:
    """``check, expected_at`` for every moment from ``start`` to before ``end``."""
    days = calendars.withColumn("day", F.explode(F.sequence(F.to_date(start), F.to_date(end)))).where(_named(F.col("day")))
    timed = days.withColumn("hour", F.explode("hours")).withColumn("minute", F.explode("minutes"))
    moments = timed.select("check", _moment(F.col("day"), F.col("hour"), F.col("minute")).alias("expected_at"))
    return moments.where((F.col("expected_at") >= start.cast("timestamp_ntz")) & (F.col("expected_at") < end.cast("timestamp_ntz")))


def calendar_due(calendars: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """Per check: last run, and whether a moment lies after it and not after ``as_of``; a check that never ran is due."""
    last = history.groupBy("check").agg(F.max("run_at").cast("timestamp_ntz").alias("last_run"))
    now = as_of.cast("timestamp_ntz")
    known = calendars.join(last, "check", "left")
    span = F.when((F.col("last_run") <= now), F.sequence(F.to_date("last_run"), F.to_date(now)))
    days = known.withColumn("day", F.explode_outer(span))

    def passed(hour: Column, minute: Column) -> Column:
        moment = _moment(F.col("day"), hour, minute)
        return (moment > F.col("last_run")) & (moment <= now)

    hit = F.col("day").isNotNull() & _named(F.col("day")) & F.exists("hours", lambda h: F.exists("minutes", lambda m: passed(h, m)))
    found = days.groupBy("check", "last_run").agg(F.bool_or(hit).alias("hit"))
    return found.select("check", "last_run", (F.col("last_run").isNull() | F.coalesce("hit", F.lit(False))).alias("due"))


def missed_moments(calendars: DataFrame, history: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every expected moment with ``ran_at``, the first run from it to before the next one (or ``end``), and ``missed``."""
    along = Window.partitionBy("check").orderBy("expected_at")
    moments = expected_moments(calendars, start, end).withColumn("until", F.coalesce(F.lead("expected_at").over(along), end.cast("timestamp_ntz")))
    spread = moments.withColumn("day", F.explode(F.sequence(F.to_date("expected_at"), F.to_date("until"))))
    runs = history.select("check", F.col("run_at").cast("timestamp_ntz").alias("run_at"), F.to_date("run_at").alias("day")).where((F.col("run_at") >= start) & (F.col("run_at") < end))
    first = F.min(F.when((F.col("run_at") >= F.col("expected_at")) & (F.col("run_at") < F.col("until")), F.col("run_at")))
    met = spread.join(runs, ["check", "day"], "left").groupBy("check", "expected_at").agg(first.alias("ran_at"))
    return met.select("check", "expected_at", "ran_at", F.col("ran_at").isNull().alias("missed"))
