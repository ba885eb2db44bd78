"""Plans and isolation: what is scanned how often, who shares a deadline, where intermediate tables go."""

import os
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions.lineage import discard, materialise, shared_dir
from plumbline.model import Check, ColumnRule, Suite
from plumbline.operators import aggregates, joins
from plumbline.plans import results as res
from plumbline.plans.suite import run_checks
from plumbline.plans.validate import rule_report, validate
from plumbline.sources import frame_connection, parquet_connection
from plumbline.sources.connections import jdbc_query_connection, query_reader
from plumbline.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Counted:
    """How many rows a table's scans have read so far."""

    def __init__(self, spark, n):
        self.spark, self.seen = spark, spark.sparkContext.accumulator(0)
        seen = self.seen

        def each(rows):
            for row in rows:
                seen.add(1)
                yield row

        self.n = n
        self.df = spark.createDataFrame(spark.sparkContext.parallelize([(k, k % 7) for k in range(n)], 2).mapPartitions(each), "k int, v int")

    def scans(self):
        return self.seen.value / self.n


def test_a_passing_table_is_scanned_once_and_a_failing_one_twice(spark):
    good = Counted(spark, 50)
    assert validate(good.df, [ColumnRule("k", range=(0, 49)), ColumnRule("v", range=(0, 6))]).first()["status"] == "PASS"
    assert good.scans() == 1
    bad = Counted(spark, 50)
    got = validate(bad.df, [ColumnRule("k", range=(5, 40)), ColumnRule("v", range=(1, 6))]).first()
    assert got["status"] == "FAIL" and len(got["sample"]) == 10
    assert bad.scans() == 2


def test_quartiles_take_two_scans_that_answer_the_other_rules_as_well(spark):
    table = Counted(spark, 3000)
    rules = [ColumnRule("k", outliers="iqr", range=(0, 5000), not_null=True), ColumnRule("v", outliers="zscore", distribution="normal")]
    got = {(r["column"], r["rule"]): r["violations"] for r in rule_report(table.df, rules).collect()}
    assert got == {("k", "not_null"): 0, ("k", "range"): 0, ("k", "outliers"): 0, ("v", "outliers"): 0, ("v", "distribution"): 1}
    assert table.scans() == 2


def test_bounds_reach_the_scan_in_the_columns_own_type(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1 << 53, (1 << 53) + 4).selectExpr("id", "cast(id AS decimal(20,0)) AS d", "cast(id % 3 AS short) AS s").write.parquet(path)
    df = spark.read.parquet(path)
    rule = ColumnRule("id", range=(0, float((1 << 53) + 2)))
    from plumbline.plans.rules import compile_rules

    bad = df.where(compile_rules([rule], df.schema)[0].predicate())
    assert [r["id"] for r in bad.collect()] == [(1 << 53) + 3]
    assert "PushedFilters: [" in plan(bad) and "GreaterThan(id" in plan(bad)
    assert df.where(compile_rules([ColumnRule("s", range=(0.5, 1e9))], df.schema)[0].predicate()).count() == 1
    assert validate(df, [ColumnRule("d", unique=True)]).first()["status"] == "PASS"


def test_three_parents_take_one_scan_of_the_child(spark, tmp_path):
    paths = {}
    for name, rows in {"child": [(1, 1, 1), (2, 9, 1), (3, None, 2), (4, 1, 9)], "parent": [(1, 0, 0), (2, 0, 0), (1, 0, 0)]}.items():
        paths[name] = str(tmp_path / name)
        spark.createDataFrame(rows, "id int, a int, b int").write.parquet(paths[name])
    child, parent = spark.read.parquet(paths["child"]), spark.read.parquet(paths["parent"])
    lost = joins.orphans_of_any(child, [(parent, "a", "id"), (parent, "b", "id"), (parent, "a", "id")])
    assert sorted(r["id"] for r in lost.collect()) == [2, 3, 4]
    final = plan(lost).split("Initial Plan")[0]
    scans = [line for line in final.splitlines() if "FileScan parquet" in line and "b#" in line]  # only the child's are read with b
    assert len(scans) == 2  # joined rows, and those with NULL keys


def test_pairs_of_columns_let_null_keys_skip_the_join(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (None,)], "j int")
    assert [r["k"] for r in joins.with_match(left, right, [("k", "j")]).collect()] == [2]
    assert sorted(str(r["k"]) for r in joins.without_match(left, right, [("k", "j")]).collect()) == ["1", "None"]


def test_texts_are_counted_by_digest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 2), (None, 2), ("a", 3)], "t string, n1 int")
    got = aggregates.duplicates(df, ["t", "n1"])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["('a', 1, 2)", "(None, 2, 2)"]


def test_frames_of_one_name_stay_apart(spark):
    spark.range(7).createOrReplaceTempView("t")
    pair = [frame_connection("a", {"t": spark.range(1)}), frame_connection("b", {"t": spark.range(2)})]
    checks = [Check(f"{on}{n}", "SELECT * FROM t", on=on, fail=f"rows.count != {n}") for on in "ab" for n in (1, 2)]
    got = {c.name: o.status for c, o in run_checks(spark, Suite(pair, checks))}
    assert got == {"a1": "PASS", "a2": "FAIL", "b1": "FAIL", "b2": "PASS"}
    assert spark.table("t").count() == 7


def test_a_cheap_check_survives_a_slow_one_on_the_same_query(spark):
    sleepy = "SELECT id % 5 AS v, java_method('java.lang.Math', 'abs', cast(id AS int)) AS w FROM range(0, 6000000, 1, 8)"
    checks = [
        Check("cheap", sleepy, timeout="4s", fail="rows.count == 0"),
        Check("dear", sleepy, timeout="4s", validate=[ColumnRule("w", unique=True, outliers="iqr", matches="^([0-9]+)+$")]),
    ]
    began = time.time()
    got = {c.name: o.status for c, o in run_checks(spark, Suite([frame_connection("f", {"x": spark.range(1)})], checks))}
    assert got["cheap"] == "PASS" and time.time() - began < 60
    assert got["dear"] in ("ERROR", "FAIL")


def test_no_deadline_unless_asked_for():
    assert Check("c", "q").timeout_secs is None and Check("c", "q", timeout="2m").timeout_secs == 120


def test_intermediate_tables_lie_in_the_shared_folder_and_go(spark, tmp_path, monkeypatch):
    from plumbline.functions import lineage

    monkeypatch.setattr(lineage, "shared_dir", lambda spark: str(tmp_path))
    df, path = materialise(spark.range(5))
    assert path.startswith(str(tmp_path)) and df.count() == 5 and "parquet" in plan(df).lower()
    discard(spark, path)
    assert not os.path.exists(path)
    validate(spark.range(5).toDF("k"), [ColumnRule("k", unique=True)], reuse=True)
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_a_database_gets_the_sql_as_it_is(spark):
    made = jdbc_query_connection("db", "jdbc:x://h/d", user="u")
    assert made.live and query_reader(spark, made.options, " SELECT 1 FROM t; ") == {"url": "jdbc:x://h/d", "user": "u", "query": "SELECT 1 FROM t"}


def test_digest_keeps_its_limit_and_its_characters(spark):
    rows = [(0, "a" * 50, "FAIL", "é" * 3000, [])]
    df = spark.createDataFrame(rows, "ord int, check string, status string, detail string, sample array<string>")
    for title, limit in (("x" * 9000, 8192), ("é" * 5000, 8192), ("日" * 5000, 8191), ("\U0001f600" * 3000, 8190), ("ok", 8192)):
        got = res.failure_digest(df, title, "s", limit).first()["digest"]
        assert limit - 4 < len(got.encode()) <= limit if title != "ok" else got.startswith("ok: 1/1")
        assert "�" not in got


def test_windows_refuse_what_they_cannot_judge(spark, tmp_path):
    stream = jobs.read_stream(spark, str(tmp_path), "ts timestamp, v int")
    for rule in (ColumnRule("v", unique=True), ColumnRule("v", outliers="iqr"), ColumnRule("v", distribution="normal"), ColumnRule("gone", not_null=True)):
        with pytest.raises(ValueError):
            jobs.window_rules(stream, [rule], "ts", "1 hour", "1 hour")


def test_a_stream_runs_as_a_service_until_it_is_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1,), (None,)], "k int").write.parquet(source)
    stream = jobs.read_stream(spark, source, "k int")
    query = jobs.validate_stream(stream, [ColumnRule("k", not_null=True)], "c", out, str(tmp_path / "cp"), trigger={"processingTime": "200 milliseconds"})
    try:
        query.processAllAvailable()
        assert query.isActive
        spark.createDataFrame([(2,)], "k int").write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["status"] for r in spark.read.parquet(out).collect()) == ["FAIL", "PASS"]


def test_stream_orphans_of_null_and_hot_keys(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(k, None if k % 5 == 0 else k % 3) for k in range(60)], "id int, key int").write.parquet(source)
    known = spark.createDataFrame([(1,), (1,), (None,)], "key int")
    lost = jobs.stream_orphans(jobs.read_stream(spark, source, "id int, key int"), known, "key", "key")
    jobs.write_table(lost, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = [k for k in range(60) if k % 5 == 0 or k % 3 != 1]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_stream_orphans_never_broadcast_the_spread_parents(spark, tmp_path, capsys):
    source, parents = str(tmp_path / "in"), str(tmp_path / "parents")
    spark.createDataFrame([(k, k) for k in range(40)] + [(40, None)], "id int, key int").write.parquet(source)
    spark.range(30).write.parquet(parents)  # small enough for a broadcast
    lost = jobs.stream_orphans(jobs.read_stream(spark, source, "id int, key int"), spark.read.parquet(parents), "key", "id")
    run = jobs.write_table(lost, str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination()
    run.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30, 41))


def test_open_windows_are_recorded_when_asked_for(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1 AS v").write.parquet(source)
    counted = jobs.sliding_volume(jobs.read_stream(spark, source, "ts timestamp, v int"), "ts", "1 hour", "1 hour", "1 hour")
    jobs.write_latest(counted, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["n_rows"] for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("n_rows") > 0).collect()] == [1]


def test_connections_of_files_are_not_fetched_first():
    assert not parquet_connection("p", "/x", ["t"]).live
