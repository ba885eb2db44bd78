"""Durations, intervals and ages, as plain values and as column expressions."""

from __future__ import annotations

import os
import re
from datetime import UTC, datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import quote

# Unit letters and their length in seconds.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
#: A number as texts may hold it; casts alone would also take suffixes such as ``5d``.
NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def duration(text: str) -> float:
    """Seconds in ``"30m"``-style text; fractions allowed."""
    number, unit = text[:-1], text[-1:]
    if not re.fullmatch(NUMBER, number):
        raise ValueError(f"bad duration: {quote(text)}")
    amount = float(number)
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unknown duration unit in {quote(text)} (use s/m/h/d)")
    return amount * UNIT_SECONDS[unit]


def interval_secs(text: str) -> int | None:
    """Whole seconds in ``"5m"``-style text, ``None`` when it is not one."""
    match = re.fullmatch(r"\s*\+?([0-9]+)\s*([smhd])\s*", text) if isinstance(text, str) else None
    return int(match[1]) * UNIT_SECONDS[match[2]] if match else None


def env(name: str) -> str:
    if name not in os.environ:
        raise KeyError(f"env var {quote(name)} not set")
    return os.environ[name]


def utc(moment: datetime) -> datetime:
    """The moment with its zone; one without a zone is taken as UTC."""
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def moment(as_of: datetime | None) -> Column:
    """``as_of`` as a timestamp column, the current time when not given."""
    return F.lit(f"{utc(as_of):%Y-%m-%d %H:%M:%S.%f}+00:00").cast("timestamp") if as_of else F.current_timestamp()


def _unit_factor(unit: Column) -> Column:
    factor = F.lit(None).cast("double")
    for letter, seconds in UNIT_SECONDS.items():
        factor = F.when(unit == letter, F.lit(float(seconds))).otherwise(factor)
    return factor


def duration_seconds(text: Column) -> Column:
    """Column form of :func:`duration`; NULL where the text is no duration."""
    number = text.substr(F.lit(1), F.length(text) - 1)
    number = F.when(number.rlike(rf"^{NUMBER}\z"), number.try_cast("double"))
    return number * _unit_factor(F.right(text, F.lit(1)))


def interval_seconds(text: Column) -> Column:
    """Column form of :func:`interval_secs`; NULL where the text is no interval."""
    pattern = r"^\s*\+?([0-9]+)\s*([smhd])\s*$"
    number = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    return (number * _unit_factor(F.regexp_extract(text, pattern, 2))).cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def age_seconds(ts: Column, as_of: Column) -> Column:
    return seconds_between(ts, as_of)


def age_of_epoch(epoch: Column, as_of: Column) -> Column:
    """Age of a timestamp given as a number of seconds since the epoch."""
    return micros(as_of) / F.lit(1e6) - epoch.cast("double")


def register_functions(spark: SparkSession, as_of: datetime | None = None) -> None:
    """Make ``duration(text)`` and ``age(ts)`` usable in tier conditions.

    ``age_text`` is ``age`` for texts, which must be written as dates; a text of
    digits is no number of seconds. Conditions say ``age`` for both.

    They are SQL functions, so Catalyst inlines them; no Python runs per row.
    ``age`` measures from ``as_of``, or from the current time when not given.
    """
    now = f"TIMESTAMP '{utc(as_of):%Y-%m-%d %H:%M:%S.%f}+00:00'" if as_of else "current_timestamp()"
    number = NUMBER.replace("\\", "\\\\")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION duration(t STRING) RETURNS DOUBLE
        RETURN CASE WHEN t IS NULL OR left(t, length(t) - 1) RLIKE '^{number}$' THEN cast(left(t, length(t) - 1) AS DOUBLE)
                    ELSE raise_error('bad duration: ' || t) END * CASE right(t, 1)
            WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400
            ELSE raise_error('unknown duration unit (use s/m/h/d)') END""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION age_text(t STRING) RETURNS DOUBLE
        RETURN unix_micros({now}) / 1e6D
             - CASE WHEN t IS NULL OR t RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' THEN unix_micros(cast(t AS TIMESTAMP)) / 1e6D
                    ELSE raise_error('bad timestamp: ' || t) END""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION age(t STRING, as_of TIMESTAMP DEFAULT {now}) RETURNS DOUBLE
        RETURN unix_micros(as_of) / 1e6D
             - coalesce(try_cast(t AS DOUBLE), unix_micros(cast(t AS TIMESTAMP)) / 1e6D)""")
