"""Check patterns on tiny tables, with skewed and NULL keys where it matters."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, filters, joins, schema, topk


@pytest.fixture(scope="module")
def family(spark):
    parent = spark.createDataFrame([(1, 3), (2, 0), (2, 0), (4, 9)], "id int, cap int")
    keys = [1] * 400 + [2] * 3 + [3] * 5 + [None] * 200 + [4] * 2
    child = spark.createDataFrame([(i, k, float(i)) for i, k in enumerate(keys)], "cid int, parent_id int, amount double")
    return parent, child, keys


def test_orphans(family):
    parent, child, keys = family
    lost = [i for i, k in enumerate(keys) if k not in (1, 2, 4)]
    assert sorted(r["cid"] for r in joins.orphans(child, parent, "parent_id", "id").collect()) == lost
    assert joins.orphan_count(child, parent, "parent_id", "id").first()["n"] == len(lost)
    assert joins.orphan_count(child.limit(0), parent, "parent_id", "id").first()["n"] == 0


def test_orphans_on_two_keys(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (1, None), (None, 1)], "x int, y int")
    b = spark.createDataFrame([(1, 1), (1, None)], "p int, q int")
    assert sorted(map(tuple, joins.orphans(a, b, ["x", "y"], ["p", "q"]).collect()), key=repr) == [(1, 2), (1, None), (None, 1)]


def test_orphans_of_any_and_counts(family):
    parent, child, keys = family
    got = joins.orphans_of_any(child, [(parent, "parent_id", "id"), (parent.where("cap > 5"), "parent_id", "id")])
    assert sorted(r["cid"] for r in got.collect()) == [i for i, k in enumerate(keys) if k != 4]
    pairs = Counter(k for k in keys if k in (1, 2, 4))
    assert joins.joined_count(child, parent, "parent_id", "id").first()["n"] == pairs[1] + 2 * pairs[2] + pairs[4]
    over = joins.over_limit(child, parent.distinct(), "parent_id", "id", F.col("cap")).collect()
    assert sorted((r["id"], r["n"]) for r in over) == [(1, 400), (2, 3)]


def test_reconcile(spark):
    orders = spark.createDataFrame([(1, 150.0), (2, 75.0), (3, 5.0)], "id int, total double")
    lines = spark.createDataFrame([(1, 100.0), (1, 50.0), (2, 70.0)], "order_id int, amount double")
    args = (orders, lines, "id", "order_id", F.col("total"), F.col("amount"))
    assert {tuple(r) for r in joins.reconcile(*args).collect()} == {(2, 75.0, 70.0), (3, 5.0, 0.0)}
    assert {tuple(r) for r in joins.total_mismatch(*args).collect()} == {(2, 75.0, 70.0)}


def test_semi_and_anti(family):
    parent, child, _ = family
    on = parent["id"] == child["parent_id"]
    assert sorted(r["id"] for r in joins.with_match(parent, child, on).collect()) == [1, 2, 2, 4]
    assert joins.without_match(parent, child.where("parent_id > 1"), on).count() == 1


def test_aggregates(spark):
    rows = [("a", 1, datetime(2024, 1, 1)), ("a", 1, datetime(2024, 1, 2)), ("b", None, datetime(2024, 1, 3)), (None, 5, None)]
    df = spark.createDataFrame(rows, "k string, v int, ts timestamp_ntz")
    now = F.lit("2024-01-03 01:00:00").cast("timestamp_ntz")
    first = lambda out: tuple(out.first())
    assert first(aggregates.row_count(df)) == (4,) and first(aggregates.count_band(df, 5, 9)) == (4, False)
    assert first(aggregates.freshness(df, "ts", now)) == (3600.0,)
    assert first(aggregates.oldest_pending(df, F.col("k") == "zz", "ts", now)) == (0.0,)
    assert first(aggregates.rate(df, F.col("v") == 1)) == (0.5,) and first(aggregates.rate(df.limit(0), F.lit(True))) == (None,)
    assert first(aggregates.null_rate(df, "v")) == (0.25,)
    assert [tuple(r) for r in aggregates.duplicates(df, ["k", "v"]).collect()] == [("a", 1, 2)]
    assert first(aggregates.duplicate_count(df, "k")) == (2,) and first(aggregates.duplicate_count(df.limit(0), "k")) == (0,)
    assert first(aggregates.cardinality(df, "k")) == (2,) and first(aggregates.cardinality(df, "k", approximate=True)) == (2,)
    assert first(aggregates.net_sum(df.limit(0), F.col("v"))) == (0,)
    assert first(aggregates.ratio_of_sums(df, F.col("v") * 0, F.col("v") * 0)) == (None,)
    assert first(aggregates.max_ratio(df, F.col("v"), F.col("v") - 1)) == (1.25,)
    assert first(aggregates.mean_lag(df.limit(0), "ts", "ts")) == (0.0,)
    assert {r["k"] for r in aggregates.group_freshness(df, "k", "ts", now, "12 HOURS").collect()} == {"a"}
    assert {r["k"] for r in aggregates.group_size_not(df, ["k"], 1).collect()} == {"a"}
    assert first(aggregates.row_count(df.where(aggregates.on_day(F.col("ts"), F.lit("2024-01-02"))))) == (1,)
    assert first(aggregates.count_ratio(df, F.col("k") == "a", F.col("k") == "x")) == (None,)
    assert {r["k"] for r in aggregates.group_distinct_over(df, "k", "v", 0).collect()} == {"a", None}
    assert {r["k"] for r in aggregates.velocity_count(df, "k", 1).collect()} == {"a"}
    assert {r["k"] for r in aggregates.velocity_sum(df, "k", F.col("v"), 2).collect()} == {None}


def test_filters(spark):
    rows = [(1, "x", datetime(2024, 1, 1)), (2, "", datetime(2024, 1, 9)), (3, None, None), (-4, "Yes", datetime(2024, 1, 4))]
    df = spark.createDataFrame(rows, "n int, s string, ts timestamp_ntz")
    now = F.lit("2024-01-05").cast("timestamp_ntz")
    ids = lambda out: sorted(r["n"] for r in out.collect())
    assert ids(filters.stuck(df, F.col("n") > 0, "ts", now, "2 DAYS")) == [1]
    assert ids(filters.not_accepted(df, "s", ["x", ""])) == [-4]
    assert ids(filters.out_of_range(df, "n", 0, 2)) == [-4, 3] and ids(filters.out_of_range(df, "n")) == []
    assert ids(filters.future_dated(df, "ts", now)) == [2]
    assert ids(filters.stale_or_null(df, "ts", now, "2 DAYS")) == [1, 3]
    assert ids(filters.blank(df, "s")) == [2, 3]
    assert ids(filters.expiring(df, "ts", now, "7 DAYS")) == [2]
    assert ids(filters.implication_broken(df, F.col("n") > 1, "s")) == [3]
    assert ids(filters.text_search(df, "s", "%YES%")) == [-4] and ids(filters.text_search(df, "s", "%YES%", negate=True)) == [1, 2]
    assert ids(filters.late_arriving(df, "ts", "ts", now, "10 DAYS", "2 DAYS")) == [1]
    assert ids(filters.column_exceeds(df, "n", F.lit(2))) == [3]


def test_schema_and_latest(spark):
    df = spark.createDataFrame([(1, 2.0, datetime(2024, 1, 1)), (2, 3.0, datetime(2024, 1, 2)), (3, 4.0, None)], "a int, b double, ts timestamp_ntz")
    assert tuple(schema.column_count(df).first()) == (3, 3)
    assert schema.required_present(df, ["a", "b", "zz"]).first()["present"] == 2
    assert schema.type_matches(df, "b", ["double"]).first()["n"] == 1 and schema.type_matches(df, "zz", ["double"]).first()["n"] == 0
    assert topk.nth_latest(df, "ts").first()["a"] == 2 and topk.nth_latest(df, "ts", 1).first()["a"] == 1
