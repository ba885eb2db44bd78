"""Durations, intervals, rendering, normalising, introspection, sinks."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text, time
from plumbline.functions.lineage import fresh_dir
from plumbline.functions.normalise import normalise
from plumbline.plans.results import results_latest
from plumbline.sources import introspect, sinks

INTERVALS = {"30s": 30, "5m": 300, "2h": 7200, "1d": 86400, " 5 m ": 300, "": None, "5": None, "5x": None, "-1s": None, "1.5m": None}
DURATIONS = {"30m": 1800.0, "1.5h": 5400.0, "2d": 172800.0, "10s": 10.0}


def test_plain_values():
    assert {k: time.interval_secs(k) for k in INTERVALS} == INTERVALS
    assert {k: time.duration(k) for k in DURATIONS} == DURATIONS
    for bad in ("", "5", "xm", "5w"):
        with pytest.raises(ValueError):
            time.duration(bad)


def test_column_forms_agree(spark):
    df = spark.createDataFrame([(k,) for k in {**INTERVALS, **DURATIONS, "5w": 0}], "s string")
    rows = df.select("s", time.interval_seconds(F.col("s")).alias("i"), time.duration_seconds(F.col("s")).alias("d")).collect()
    for r in rows:
        assert r["i"] == time.interval_secs(r["s"])
        if r["s"] in DURATIONS:
            assert r["d"] == DURATIONS[r["s"]]
    assert {r["s"]: r["d"] for r in rows}["5w"] is None


def test_env(monkeypatch):
    monkeypatch.setenv("PLUMBLINE_X", "v")
    assert time.env("PLUMBLINE_X") == "v"
    with pytest.raises(KeyError, match="not set"):
        time.env("PLUMBLINE_UNSET")


def test_numbers_and_quotes():
    assert [text.plain_number(v) for v in (0, 400000.0, 0.5, -1e21, 1e-7)] == ["0", "400000", "0.5", "-1000000000000000000000", "0.0000001"]
    assert text.quote('a"b\\c\n') == '"a\\"b\\\\c\\n"'


ROW = (1, 1.5, float("nan"), Decimal("2.50"), True, "x", date(2024, 1, 5), datetime(2024, 1, 5, 6, 7, 8), datetime(2024, 1, 5, 6, 7, 8, 120000), None)
SCHEMA = "i int, d double, n double, m decimal(10,2), b boolean, s string, day date, ts timestamp_ntz, tz timestamp, z string"


def test_normalise_and_render(spark):
    df = spark.createDataFrame([ROW], SCHEMA)
    plain = normalise(df)
    assert [f.dataType.simpleString() for f in plain.schema.fields] == [
        "bigint", "double", "double", "double", "boolean", "string", "string", "string", "string", "string",
    ]
    assert tuple(plain.first()) == (
        1, 1.5, None, 2.5, True, "x", "2024-01-05", "2024-01-05T06:07:08+00:00", "2024-01-05T06:07:08.120+00:00", None
    )
    assert df.select(text.row_text(df.schema)).first()[0] == (
        "i=1 d=1.5 n=null m=2.5 b=true s=x day=2024-01-05 ts=2024-01-05T06:07:08+00:00 tz=2024-01-05T06:07:08.120+00:00 z=null"
    )
    assert df.select("i", "z").select(text.row_json(df.select("i", "z").schema)).first()[0] == '{"i":1,"z":null}'
    with pytest.raises(ValueError, match='column "v" has unhandled type array<int>'):
        normalise(spark.createDataFrame([([1],)], "v array<int>"))


def test_introspection(spark):
    tables = {"b": spark.createDataFrame([(1, "x")], "k int, v string"), "a": spark.createDataFrame([(1.0,)], "p double")}
    cols = introspect.describe_columns(spark, tables)
    assert [tuple(r)[:4] for r in cols.collect()] == [("a", 1, "p", "double"), ("b", 1, "k", "int"), ("b", 2, "v", "string")]
    grouped = {r["table_name"]: [c["name"] for c in r["columns"]] for r in introspect.grouped_by_table(cols).collect()}
    assert grouped == {"a": ["p"], "b": ["k", "v"]}
    tables["b"].createOrReplaceTempView("some_view")
    assert "some_view" in {r["table_name"] for r in introspect.describe_schema(spark).collect()}
    big = spark.range(500)
    assert [introspect.sample_table(big, n).count() for n in (None, 0, 7, 1000)] == [10, 1, 7, 100]
    assert introspect.safe_name("public.orders") == "public.orders" and introspect.probe(spark)
    for bad in ("a;b", "a b", "", "a'"):
        with pytest.raises(ValueError):
            introspect.safe_name(bad)
    tables["c"] = lambda: spark.read.parquet("/no/such/table")
    tables["d"] = tables["b"].selectExpr("assert_true(k > 5) AS x", "k")
    got = {r["table_name"]: (r["ok"], bool(r["error"])) for r in introspect.reachable(spark, tables).collect()}
    assert got == {"a": (1, False), "b": (1, False), "c": (0, True), "d": (0, True)}
    counts = {tuple(r) for r in introspect.row_counts(spark, {k: tables[k] for k in "ab"}).collect()}
    assert counts == {("a", 1), ("b", 1)}


def test_history_sink(spark):
    path = fresh_dir(spark, "test-history")
    schema = "ord int, check string, status string, detail string, sample array<string>, run_at timestamp"
    for day, status in ((1, "FAIL"), (2, "PASS"), (3, "WARN")):
        run = [(0, "a", status, "d", ["{}"], datetime(2024, 1, day, 5)), (1, "b", "PASS", "d", [], datetime(2024, 1, day, 5))]
        sinks.append_results(spark.createDataFrame(run, schema), path)
    history = sinks.read_results(spark, path)
    assert history.count() == 6 and history.where("run_date = DATE '2024-01-02'").count() == 2
    assert {(r["check"], r["status"]) for r in results_latest(history).collect()} == {("a", "WARN"), ("b", "PASS")}
    sinks.write_json(history, f"{path}-json")
    assert spark.read.json(f"{path}-json").where("name = 'a'").count() == 3
    sinks.write_yaml(history, f"{path}-yaml")
    assert spark.read.text(f"{path}-yaml").count() > 6


def test_one_broken_view_does_not_end_the_listing(spark, tmp_path):
    spark.sql(f"CREATE TABLE gone_table (id INT) USING parquet LOCATION '{tmp_path}/gone'")
    spark.sql("CREATE VIEW broken_view AS SELECT id FROM gone_table")
    spark.sql("CREATE TABLE whole_table (id INT, name STRING) USING parquet LOCATION '%s/whole'" % tmp_path)
    spark.sql("DROP TABLE gone_table")
    try:
        rows = [(r["table_name"], r["ordinal"], r["column_name"]) for r in introspect.describe_schema(spark).where("table_name LIKE 'default.%'").collect()]
        assert sorted(rows, key=str) == sorted([("default.broken_view", 0, None), ("default.whole_table", 1, "id"), ("default.whole_table", 2, "name")], key=str)
    finally:
        spark.sql("DROP VIEW IF EXISTS broken_view")
        spark.sql("DROP TABLE IF EXISTS whole_table")
