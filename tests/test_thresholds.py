"""Tiers: precedence, errors, division by zero, empty results, samples."""

import json
from datetime import datetime

import pytest

from plumbline.model import Check, Suite, Tier
from plumbline.plans.thresholds import divisors, evaluate, mentions
from plumbline.sources import static_connection

NOW = datetime(2024, 1, 5, 12)


def decide(spark, rows, schema, **tiers):
    order = tiers.pop("order_by", None)
    df = spark.createDataFrame(rows, schema)
    return evaluate(df, Check("t", "", order_by=order, **tiers), NOW).first()


@pytest.mark.parametrize(
    "rows, tiers, status",
    [
        ([(5,)], {"fail": "row.n > 3"}, "FAIL"),
        ([(2,)], {"fail": "row.n > 3"}, "PASS"),
        ([(15,)], {"warn": "row.n > 10", "fail": "row.n > 50"}, "WARN"),
        ([(60,)], {"warn": "row.n > 10", "fail": "row.n > 50"}, "FAIL"),
        ([(5,)], {}, "PASS"),
        ([(5,)], {"fail": "1 + 1"}, "ERROR"),
        ([(5,)], {"fail": "row.missing == 0"}, "ERROR"),
        ([(5,)], {"fail": "this is not ( an expression"}, "ERROR"),
        ([(5,)], {"fail": "1.0 / 0.0 < 1"}, "ERROR"),
        ([(5,)], {"fail": "10 % 0 == 0"}, "ERROR"),
        ([(5,)], {"fail": "10 / 2 > 1"}, "FAIL"),
        ([(5,)], {"fail": "row.n > 0 or row.n / (row.n - 5) > 1"}, "ERROR"),
        ([(5,)], {"fail": "case when row.n > 0 then false else row.n % (5 - row.n) = 1 end"}, "ERROR"),
        ([(5,)], {"fail": "'a/0' = 'b'"}, "PASS"),
        ([(None,)], {"fail": "row.n > 3"}, "ERROR"),
        ([(None,)], {"fail": "row.n <=> null"}, "FAIL"),
        ([(5,)], {"warn": "row.n > 1", "fail": "row.m > 1"}, "ERROR"),
        ([(5,)], {"warn": "row.m > 1", "fail": "row.n > 1"}, "FAIL"),
        ([], {"fail": "rows.count == 0"}, "FAIL"),
        ([], {"fail": "row.n == 0"}, "ERROR"),
        ([], {"fail": "rows.count == 0 or row.n == 0"}, "ERROR"),
        ([(1,), (2,), (3,)], {"fail": "rows.count == 3 and row.n == 1 and rows.sample[1].n == 2"}, "FAIL"),
        ([(90,)], {"fail": "row.n > duration('1.5m')"}, "PASS"),
        ([(91,)], {"fail": "row.n > duration('1.5m')"}, "FAIL"),
    ],
)
def test_tiers(spark, rows, tiers, status):
    got = decide(spark, rows, "n int", **tiers)
    assert got["status"] == status, got


def test_detail_and_samples(spark):
    rows = [(i,) for i in (5, 4, 3, 2, 1)]
    got = decide(spark, rows, "n int", fail=Tier("rows.count > 0", sample=2))
    assert got["detail"] == "5 row(s)" and [json.loads(s)["n"] for s in got["sample"]] == [1, 2]
    more = decide(spark, rows[:3], "n int", warn=Tier("rows.count > 0", sample=10))
    assert more["status"] == "WARN" and len(more["sample"]) == 3
    assert decide(spark, rows, "n int", fail=Tier("rows.count > 9", sample=2))["sample"] == []


def test_age_of_text_number_and_timestamp(spark):
    df = spark.sql("SELECT '2024-01-05T11:00:00+00:00' AS text, 1704452400 AS epoch, TIMESTAMP_NTZ '2024-01-05 11:00:00' AS moment")
    for column in ("text", "epoch", "moment"):
        check = Check("t", "", fail=f"age(row.{column}) = 3600 and age(row.{column}) < duration('2h')")
        assert evaluate(df, check, NOW).first()["status"] == "FAIL", column


def test_reading_conditions():
    assert divisors("a / b * c") == [("/", "b")]
    assert divisors("x % (y / z)") == [("/", "z"), ("%", "(y / z)")]
    assert divisors("row.a / nullif(row.b, 0) > 1") == [("/", "nullif(row.b, 0)")]
    assert divisors("a like '%b/c'") == []
    assert mentions("row.n > 1", "row") and not mentions("rows.count > 1 and 'row' = 'x'", "row")


@pytest.mark.parametrize(
    "make",
    [
        lambda: Check("t", "q", fail="x", validate=[]),
        lambda: Check("t", "q", warn="x", validate=[]),
        lambda: Check("t", 5),
        lambda: Check("", "q"),
        lambda: Check("t", "q", for_each="abc"),
        lambda: Check("t", "q", for_each=[1]),
        lambda: Check("t", "q", every="1.5m"),
        lambda: Check("t", "q", timeout="soon"),
        lambda: Tier("x", sustained="5x"),
        lambda: Tier("x", sample=-1),
        lambda: Tier(" "),
        lambda: Suite([], []),
        lambda: Suite([static_connection("c", {})], [Check("a", "q"), Check("a", "q")]),
    ],
)
def test_bad_checks(make):
    with pytest.raises(ValueError):
        make()


def test_divisors_come_from_the_parsed_condition(spark):
    assert divisors("row.`a/b` > 1") == []
    assert [s for s, _ in divisors("row.a / 1e-3 > 1 /* x / y */ -- z / 0")] == ["/"]
    assert [s for s, _ in divisors("mod(a, b) + c div d + pmod(e, f % g) / case when h then 1 else 0 end")] == ["mod", "div", "%", "pmod", "/"]


@pytest.mark.parametrize(("when", "status"), [
    ("row.`a/b` > 1", "FAIL"), ("row.a / 1e-3 > 1", "FAIL"), ("row.a / case when row.a > 5 then 1 else 2 end > 1", "FAIL"), ("row.a % 3 == 0 -- x / 0", "FAIL"),
    ("row.a / case when row.a > 5 then 0 else 2 end > 1", "ERROR"), ("row.a / row.`zero` > 1", "ERROR"), ("row.a > 1 or row.a / row.zero > 1", "ERROR"),
    ("exists(array(1, 2), x -> row.a / x > 1)", "ERROR"), ("cast(row.t as int) > 1", "ERROR"), ("row.a / cast(row.t as int) > 1", "ERROR"),
])
def test_divisions_and_casts_in_every_form(spark, when, status):
    df = spark.createDataFrame([(9, 3, 0, "word")], "a int, `a/b` int, zero int, t string")
    assert verdict_of(df, when) == status


def verdict_of(df, when):
    return evaluate(df, Check("t", "", fail=when), NOW).first()["status"]
