"""Column rules on tiny tables: a passing and a failing case each."""

import datetime as dt
import json
import math
from decimal import Decimal
from statistics import NormalDist

import pytest

from plumbline.model import ColumnRule
from plumbline.plans.rules import java_pattern
from plumbline.plans.validate import rule_report, validate


def run(spark, rows, schema, *rules, order_by=None):
    df = spark.createDataFrame(rows, schema)
    return validate(df, rules, "t", order_by).first()


def ones(values):
    return [(v,) for v in values]


CODE = r"^[A-Z]{2}-[0-9]{4}$"
PLATES = [f"QX-{1000 + 7 * k}" for k in range(3)]
STEADY = [40 + k % 5 for k in range(20)]
GRID = [(k + 0.5) / 60 for k in range(60)]
BELL = [17 + 3 * NormalDist().inv_cdf(p) for p in GRID]
SKEWED = [-math.log(1 - p) for p in GRID]


@pytest.mark.parametrize(
    "values, kind, rule, status, words",
    [
        ([6, -2, 900, 14], "int", ColumnRule("c", type="int"), "PASS", "4 row(s), all rules passed"),
        (["seven", "0.25"], "string", ColumnRule("c", type="int"), "FAIL", 'column "c": type=int: 2 value(s) non-conforming'),
        (PLATES, "string", ColumnRule("c", not_null=True), "PASS", ""),
        ([None, *PLATES, None], "string", ColumnRule("c", not_null=True), "FAIL", 'column "c": not_null: 2 null value(s) found'),
        ([PLATES[0], None], "string", ColumnRule("c", not_null=False), "PASS", ""),
        (PLATES * 4, "string", ColumnRule("c", null_rate=0.05), "PASS", ""),
        (PLATES + [None], "string", ColumnRule("c", null_rate=0.2), "FAIL",
         'column "c": null_rate: 25.00% nulls exceeds threshold 20.00%'),
        ([None, "a"], "string", ColumnRule("c", null_rate=0.5), "PASS", ""),
        (["teal", "ochre"], "string", ColumnRule("c", allowed=["ochre", "teal", "plum"]), "PASS", ""),
        (["teal", "puce", "ochre", "puce"], "string", ColumnRule("c", allowed=["ochre", "teal"]), "FAIL",
         'column "c": allowed: 2 value(s) not in allowed set ["ochre", "teal"]'),
        ([1, 2, 3], "bigint", ColumnRule("c", allowed=["1", "2"]), "FAIL", "1 value(s)"),
        ([True, False], "boolean", ColumnRule("c", allowed=["true"]), "FAIL", "1 value(s)"),
        (PLATES, "string", ColumnRule("c", matches=CODE), "PASS", ""),
        ([*PLATES, "qx-1000", "QX-10"], "string", ColumnRule("c", matches=CODE), "FAIL", "2 value(s) do not match pattern"),
        (["ab\n"], "string", ColumnRule("c", matches="^ab$"), "FAIL", "1 value(s)"),
        ([-8, 3, 64], "int", ColumnRule("c", range=(-8, 64)), "PASS", ""),
        ([-9, 65, 3], "int", ColumnRule("c", range={"min": -8, "max": 64}), "FAIL", 'column "c": range=[-8,64]: 2 value(s) out of range'),
        (["3"], "string", ColumnRule("c", range=(-8, 64)), "FAIL", "1 value(s) out of range"),
        ([0.5], "double", ColumnRule("c", range=(0.75, 1)), "FAIL", "range=[0.75,1]: 1"),
        (PLATES, "string", ColumnRule("c", unique=True), "PASS", ""),
        (PLATES + PLATES[1:], "string", ColumnRule("c", unique=True), "FAIL", "2 duplicate(s) found in 5 non-null values"),
        ([None, None, "a"], "string", ColumnRule("c", unique=True), "PASS", ""),
        (STEADY, "int", ColumnRule("c", outliers="iqr"), "PASS", ""),
        (STEADY + [90], "int", ColumnRule("c", outliers="iqr"), "FAIL", 'column "c": outliers=iqr: 1 outlier(s) found'),
        ([4, 4, 700], "int", ColumnRule("c", outliers="iqr"), "PASS", ""),
        (["x", "y"], "string", ColumnRule("c", outliers="iqr"), "PASS", ""),
        ([1] * 9 + [100], "int", ColumnRule("c", outliers="zscore"), "PASS", ""),
        ([1] * 10 + [100], "int", ColumnRule("c", outliers="zscore"), "FAIL", "outliers=zscore: 1 outlier(s) found"),
        ([7] * 20, "int", ColumnRule("c", outliers="zscore"), "PASS", ""),
        ([1, 2], "int", ColumnRule("c", outliers="zscore"), "PASS", ""),
        (BELL, "double", ColumnRule("c", distribution="normal"), "PASS", ""),
        (SKEWED, "double", ColumnRule("c", distribution="normal"), "FAIL", "Jarque-Bera p=0.0000 < 0.05 (not normal)"),
        (BELL[:7], "double", ColumnRule("c", distribution="normal"), "ERROR",
         'column "c": distribution=normal: normality test needs >= 8 non-null values, got 7'),
        ([3.0] * 9, "double", ColumnRule("c", distribution="normal"), "ERROR", "all values are identical; cannot compute normality test"),
        (["a"] * 9, "string", ColumnRule("c", distribution="normal"), "ERROR", "got 0"),
        ([1], "int", ColumnRule("plate", not_null=True), "ERROR", 'column "plate" not found in query result (check "t")'),
        ([], "int", ColumnRule("plate", not_null=True), "PASS", "0 row(s), no violations"),
        ([None, None], "int", ColumnRule("c", type="string", unique=True, range=(0, 1), outliers="iqr"), "PASS", ""),
        ([1.0, float("nan"), float("inf")], "double", ColumnRule("c", not_null=True), "FAIL", "2 null value(s)"),
        ([1.5, float("nan")], "double", ColumnRule("c", type="int", range=(0, 2)), "FAIL", "type=int: 1 value(s)"),
    ],
)
def test_rule(spark, values, kind, rule, status, words):
    got = run(spark, ones(values), f"c {kind}", rule)
    assert (got["status"], words in got["detail"]) == (status, True), got


DAY = dt.date(2024, 1, 5)
MOMENT = dt.datetime(2024, 1, 5, 6, 7, 8)


@pytest.mark.parametrize(
    "kind, value, conforming",
    [
        ("bigint", 5, {"int", "float"}),
        ("double", 5.0, {"int", "float"}),
        ("double", 5.5, {"float"}),
        ("decimal(10,2)", Decimal("5.00"), {"int", "float"}),
        ("decimal(10,2)", Decimal("5.25"), {"float"}),
        ("string", "42", {"string"}),
        ("string", "2024-01-05T06:07:08Z", {"string", "timestamp"}),
        ("string", "2024-01-05T06:07:08.123+02:00", {"string", "timestamp"}),
        ("string", "2024-01-05 06:07:08", {"string", "timestamp"}),
        ("string", "2024-01-05T06:07:60Z", {"string", "timestamp"}),
        ("string", "2024-01-05 06:60:07", {"string"}),
        ("string", "2024-02-31 06:07:08", {"string"}),
        ("string", "2024-01-05", {"string"}),
        ("boolean", True, {"bool"}),
        ("timestamp", MOMENT, {"string", "timestamp"}),
        ("timestamp_ntz", MOMENT, {"string", "timestamp"}),
        ("date", DAY, {"string", "timestamp"}),
    ],
)
def test_type_table(spark, kind, value, conforming):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    kinds = ("int", "float", "string", "bool", "timestamp")
    report = rule_report(df, [ColumnRule("c", type=k) for k in kinds]).collect()
    assert {k for k, r in zip(kinds, report, strict=True) if r["status"] == "PASS"} == conforming


def test_several_columns(spark):
    rules = [ColumnRule("plate", not_null=True, matches=CODE), ColumnRule("load", range=(-8, 64)), ColumnRule("paint", allowed=["teal", "plum"])]
    schema = "plate string, load int, paint string"
    assert run(spark, [(PLATES[0], 5, "teal"), (PLATES[1], 64, "plum")], schema, *rules)["status"] == "PASS"
    got = run(spark, [(PLATES[2], 70, "teal")], schema, *rules)
    assert got["status"] == "FAIL" and "load" in got["detail"] and json.loads(got["sample"][0])["load"] == 70


def test_order_of_messages_and_error_precedence(spark):
    rows = [(1.5, None), (1.5, "x"), (9.0, "x")]
    both = [ColumnRule("a", type="int", range=(0, 5), unique=True), ColumnRule("b", not_null=True)]
    got = run(spark, rows, "a double, b string", *both)
    assert got["detail"] == (
        'column "a": type=int: 2 value(s) non-conforming, column "a": range=[0,5]: 1 value(s) out of range, '
        'column "a": unique: 1 duplicate(s) found in 3 non-null values; column "b": not_null: 1 null value(s) found'
    )
    broken = run(spark, rows, "a double, b string", *both, ColumnRule("a", distribution="normal"), ColumnRule("zz", unique=True))
    assert broken["status"] == "ERROR" and "needs >= 8" in broken["detail"] and broken["sample"] == []


def test_sample_order_and_limits(spark):
    rows = [(i, None if i < 12 else i) for i in range(30)]
    rules = [ColumnRule("v", not_null=True), ColumnRule("k", range=(20, 100))]
    got = run(spark, rows, "k int, v int", *rules, order_by=["k"])
    assert [json.loads(s)["k"] for s in got["sample"]] == list(range(10))
    few = run(spark, [(1, None), (2, 5), (3, 6)], "k int, v int", ColumnRule("v", not_null=True), ColumnRule("k", range=(3, 9)), order_by=["k"])
    assert [json.loads(s)["k"] for s in few["sample"]] == [1, 1, 2]
    assert json.loads(few["sample"][0]) == {"k": 1, "v": None}


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([(None, 1)], "`a b.c` string, `x%y` int")
    got = validate(df, [ColumnRule("a b.c", null_rate=0.0), ColumnRule("x%y", range=(2, 3))], "t").first()
    assert got["detail"] == (
        'column "a b.c": null_rate: 100.00% nulls exceeds threshold 0.00%; column "x%y": range=[2,3]: 1 value(s) out of range'
    )


def test_reuse_writes_once_and_agrees(spark):
    df = spark.createDataFrame(ones(STEADY + [90]), "c int")
    rules = [ColumnRule("c", outliers="iqr", unique=True)]
    assert validate(df, rules, "t", reuse=True).first() == validate(df, rules, "t").first()


@pytest.mark.parametrize(
    "make, words",
    [
        (lambda: ColumnRule("c", type="number"), "no such type"),
        (lambda: ColumnRule("c", type=3), "needs text"),
        (lambda: ColumnRule("c", outliers="mad"), "no such outliers method"),
        (lambda: ColumnRule("c", distribution="uniform"), "no such distribution"),
        (lambda: ColumnRule("c", not_null="yes"), "true or false"),
        (lambda: ColumnRule("c", unique=1), "true or false"),
        (lambda: ColumnRule("c", null_rate="x"), "needs a number"),
        (lambda: ColumnRule("c", null_rate=1.5), "a share from 0 to 1"),
        (lambda: ColumnRule("c", allowed="teal"), "needs a list"),
        (lambda: ColumnRule("c", allowed=["teal", 1]), "only text"),
        (lambda: ColumnRule("c", matches="(unclosed"), "cannot be used"),
        (lambda: ColumnRule("c", matches="(?=x)y"), "lookaround"),
        (lambda: ColumnRule("c", matches=r"(a)\1"), "backreferences"),
        (lambda: ColumnRule("c", matches=3), "needs text"),
        (lambda: ColumnRule("c", range={"min": 0}), "lacks `max`"),
        (lambda: ColumnRule("c", range=(2, 1)), "is empty"),
        (lambda: ColumnRule("c", range=("a", 1)), "needs a number"),
        (lambda: ColumnRule.from_dict("c", {"rnage": (0, 1)}), "has no rule `rnage`"),
    ],
)
def test_bad_rules(make, words):
    with pytest.raises(ValueError, match=None) as err:
        make()
    assert words in str(err.value)


def test_pattern_spelling():
    assert java_pattern("^a$") == r"(?d)^a\z"
    assert java_pattern(r"[$]\$x$") == r"(?d)[$]\$x\z"
    assert java_pattern(r"^\d+$") == r"(?dU)^\d+\z"
    assert java_pattern("(?P<n>a)") == "(?d)(?<n>a)"
