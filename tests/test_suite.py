"""Suites: isolation, fan-out, defaults, shared passes, timeouts, connections."""

import time
from datetime import datetime

import pytest

from plumbline.model import Check, ColumnRule, Defaults, Suite, Tier
from plumbline.plans import results as res
from plumbline.plans.suite import run_check, run_suite, suite_frame
from plumbline.sources import (
    Connection, catalog_connection, frame_connection, jdbc_connection, parquet_connection, static_connection,
)

NOW = datetime(2024, 1, 5, 12)


def orders(n):
    return static_connection("main", {"orders": ([(i, float(i)) for i in range(1, n + 1)], "id int, amount double")})


def outcome(spark, suite, **kw):
    return [(r["check"], r["status"], r["detail"]) for r in run_suite(spark, suite, NOW, **kw).orderBy("ord").collect()]


def test_pass_fail_error_in_order(spark):
    checks = [
        Check("bad_table", "select * from nowhere", fail="rows.count > 0"),
        Check("present", "select count(*) as n from orders", fail="row.n == 0"),
        Check("bad_column", "select amout from orders", fail="rows.count > 0"),
        Check("bad_division", "select 1 / 0 as x from orders", fail="row.x > 0"),
        Check("big", "select * from orders where amount > 3", fail=Tier("rows.count > 0", sample=1)),
        Check("valid", "select * from orders", validate=[ColumnRule("amount", range=(0, 3))]),
    ]
    got = outcome(spark, Suite([orders(5)], checks))
    assert [s for _, s, _ in got] == ["ERROR", "PASS", "ERROR", "ERROR", "FAIL", "FAIL"]
    assert [c for c, _, _ in got] == [c.name for c in checks]
    assert "TABLE_OR_VIEW_NOT_FOUND" in got[0][2] and "UNRESOLVED_COLUMN" in got[2][2] and "DIVIDE_BY_ZERO" in got[3][2]


def test_dead_and_unknown_connections(spark):
    dead = parquet_connection("replica", "/nonexistent", ["t"])
    checks = [
        Check("a", "select 1 as ok", on="replica"), Check("b", "select 1 as ok", on="typo"), Check("c", "select count(*) as n from orders"),
    ]
    start = time.time()
    got = outcome(spark, Suite([orders(2), dead], checks))
    assert got[0][1] == "ERROR" and got[0][2].startswith('connection "replica" unavailable: ')
    assert got[1][2] == 'check "b" references unknown connection "typo"; declared connections: ["main", "replica"]'
    assert got[2][1:] == ("PASS", "1 row(s)") and time.time() - start < 30


def test_connections_do_not_see_each_other(spark):
    one = static_connection("one", {"t": ([(1,)], "n int")})
    two = static_connection("two", {"t": ([(2,)], "n int"), "only_two": ([(2,)], "n int")})
    checks = [
        Check("a", "select n from t", on="one", fail="row.n != 1"), Check("b", "select n from t", on="two", fail="row.n != 2"),
        Check("c", "select n from only_two", on="one"),
    ]
    assert [s for _, s, _ in outcome(spark, Suite([one, two], checks))] == ["PASS", "PASS", "ERROR"]


def test_for_each_and_defaults(spark):
    tables = {"a": ([(1,)], "n int"), "b": ([], "n int")}
    each = Check("not_empty", "select count(*) as n from ${each.value}", for_each=["a", "b"], fail=Tier("row.n == 0", sustained="5m"))
    plain = Check("plain", "select 1 as n", on="x", every="1h", on_fail="pager")
    suite = Suite([static_connection("x", tables)], [each, plain, Check("none", "select 1 as n", for_each=[])], Defaults(every="5m", on_fail="ops"))
    assert [(c, s) for c, s, _ in outcome(spark, suite)] == [("not_empty[a]", "PASS"), ("not_empty[b]", "FAIL"), ("plain", "PASS"), ("none", "PASS")]
    listed = {r["check"]: r for r in suite_frame(spark, suite).collect()}
    assert listed["not_empty[a]"]["query"] == "select count(*) as n from a"
    assert (listed["not_empty[a]"]["every_secs"], listed["plain"]["every_secs"]) == (300, 3600)
    assert (listed["not_empty[b]"]["sustained_secs"], listed["plain"]["on_fail"], listed["none"]["on_fail"]) == (300, "pager", "ops")
    assert listed["not_empty[a]"]["conditions"] == ["fail"]


def test_one_check_by_name(spark):
    each = Check("count", "select count(*) as n from orders where id > ${each.value}", for_each=["0", "9"], fail="row.n == 0")
    suite = Suite([orders(2)], [each], Defaults(timeout="1m"))
    assert run_check(spark, suite, "count[9]", NOW).first()["status"] == "FAIL"
    with pytest.raises(ValueError) as err:
        run_check(spark, suite, "count")
    assert str(err.value) == 'check "count" not found; available: ["count[0]", "count[9]"]'


def test_same_query_is_one_job_and_one_bad_check_does_not_spoil_it(spark):
    q = "select * from orders"
    checks = [
        Check("count", q, fail="rows.count != 4"),
        Check("rules", q, validate=[ColumnRule("id", unique=True), ColumnRule("amount", outliers="zscore")]),
        Check("cast", q, fail="cast(concat('x', row.id) as int) > 1"),
        Check("first", q, fail="row.id != 1"),
    ]
    got = outcome(spark, Suite([orders(4)], checks))
    assert [s for _, s, _ in got] == ["PASS", "PASS", "ERROR", "PASS"] and "CAST_INVALID_INPUT" in got[2][2]


def test_unsupported_type_names_the_column(spark):
    rows = static_connection("x", {"t": ([([1.0],)], "v array<double>")})
    got = outcome(spark, Suite([rows], [Check("c", "select * from t", fail="rows.count > 5")]))
    assert got == [("c", "ERROR", 'column "v" has unhandled type array<double>')]


def test_query_can_be_a_function_and_be_written_once(spark):
    check = Check("c", lambda s: s.table("orders").groupBy("id").count(), validate=[ColumnRule("count", range=(1, 1))], materialise=True)
    assert outcome(spark, Suite([orders(3)], [check])) == [("c", "PASS", "3 row(s), all rules passed")]


def test_timeout_stops_the_query(spark):
    slow = "select count(*) as n from range(0, 1000000000000, 1, 64) where id % 7 = 3 and sqrt(id) > 5"
    checks = [Check("slow", slow, timeout="2s", fail="row.n > 0"), Check("quick", "select count(*) as n from orders")]
    start = time.time()
    got = outcome(spark, Suite([orders(2)], checks))
    assert got[0][1:] == ("ERROR", "query exceeded timeout (2s)") and got[1][1] == "PASS"
    assert time.time() - start < 60


def test_many_checks_at_once(spark):
    checks = [Check(f"c{i}", f"select count(*) as n from orders where id > {i}", fail="row.n < 0") for i in range(20)]
    assert {s for _, s, _ in outcome(spark, Suite([orders(25)], checks))} == {"PASS"}


def test_connection_failure_of_any_kind(spark):
    def broken(session):
        raise RuntimeError("no route to host")

    got = outcome(spark, Suite([Connection("x", broken)], [Check("c", "select 1 as n")]))
    assert got == [("c", "ERROR", 'connection "x" unavailable: no route to host')]


def test_catalog_frames_and_databases(spark):
    spark.range(3).createOrReplaceGlobalTempView("three_rows")
    catalog = catalog_connection("catalog", ["three_rows"], "global_temp")
    frames = frame_connection("frames", {"four_rows": spark.range(4)})
    database = jdbc_connection("database", "jdbc:nosuchdriver://localhost/x", {"t": {}})
    checks = [
        Check("a", "select count(*) as n from three_rows", on="catalog", fail="row.n != 3"),
        Check("b", "select count(*) as n from four_rows", on="frames", fail="row.n != 4"),
        Check("c", "select count(*) as n from t", on="database"),
    ]
    got = outcome(spark, Suite([catalog, frames, database], checks))
    assert [s for _, s, _ in got] == ["PASS", "PASS", "ERROR"]
    assert got[2][2].startswith('connection "database" unavailable: ')


RESULTS = [
    (0, "ok", "main", "PASS", "1 row(s)", []),
    (1, "slow", "main", "WARN", "2 row(s)", []),
    (2, "bad\"one", "main", "FAIL", "3 row(s)", ['{"id":1}', '{"id":2}', '{"id":3}']),
    (3, "broken", "main", "ERROR", "boom", []),
]


@pytest.fixture
def results(spark):
    return spark.createDataFrame(RESULTS, "ord int, check string, connection string, status string, detail string, sample array<string>")


def test_health_and_counts(spark, results):
    assert res.results_health(results).first()["http_status"] == 503
    assert res.results_health(results.where("status in ('PASS', 'WARN')")).first()["http_status"] == 200
    assert res.results_health(results.limit(0)).first()["http_status"] == 200
    assert tuple(res.results_summary(results).first()) == (4, 1, 1, 2, 1, "fail")
    assert res.failing_json(results).first()[0] == (
        '[{"name":"bad\\"one","status":"FAIL","detail":"3 row(s)"},{"name":"broken","status":"ERROR","detail":"boom"}]'
    )
    assert res.failing_json(results.limit(0)).first()[0] == "[]"
    assert res.results_summary(results.limit(0)).first()["status"] == "pass"


def test_filter(spark, results):
    assert [r["check"] for r in res.results_filter(results, limit=2).collect()] == ["ok", "slow"]
    assert [r["check"] for r in res.results_filter(results, "error").collect()] == ["broken"]


def test_gauges(spark, results):
    lines = [r["line"] for r in res.gauge_text(results, "dq").collect()]
    assert lines[0].startswith("# HELP dq_check_status") and lines[1] == "# TYPE dq_check_status gauge"
    assert 'dq_check_status{check="bad\\"one"} 2' in lines and 'dq_check_up{check="slow"} 1' in lines and len(lines) == 12


def test_reports(spark, results):
    lines = [r["line"] for r in res.report_text(results).orderBy("ord", "line_no").collect()]
    assert lines[0] == f"  [PASS] {'ok':32} 1 row(s)" and lines[3] == "      id=1" and lines[-1].startswith("  [ERR ] broken")
    objects = [r["json"] for r in res.report_json(results).orderBy("ord").collect()]
    assert objects[2] == '{"name":"bad\\"one","status":"fail","detail":"3 row(s)","sample":[{"id":1},{"id":2},{"id":3}]}'
    blocks = [r["yaml"] for r in res.report_yaml(results).orderBy("ord").collect()]
    assert blocks[2].split("\n")[:2] == ['- name: "bad\\"one"', '  status: "fail"'] and blocks[0].endswith("sample: []")


def test_failure_text_and_digest(spark, results):
    text = res.failure_text(results).first()["failures"]
    assert text == 'FAIL  bad"one — 3 row(s)\n  {"id":1}\n  {"id":2}\nERROR  broken — boom\n'
    digest = res.failure_digest(results, "nightly", "shop").first()
    assert digest["digest"] == 'nightly: 2/4 checks FAILED on "shop"\n' + text and digest["more"] == 0


def test_digest_is_bounded(spark):
    many = [(i, f"check_{i:04}", "m", "FAIL", "é" * 100, ['{"id":1}'] * 5) for i in range(400)]
    df = spark.createDataFrame(many, "ord int, check string, connection string, status string, detail string, sample array<string>")
    got = res.failure_digest(df, "nightly", "shop").first()
    body = got["digest"]
    assert len(body.encode()) <= 8192 and got["shown"] + got["more"] == 400
    assert body.endswith(f"(+{got['more']} more checks)\n") and body.startswith('nightly: 400/400 checks FAILED on "shop"\n')
    # As many as fit, by hand: the first check whose headline does not fit ends the list.
    used, shown = len(b'nightly: 400/400 checks FAILED on "shop"\n'), 0
    for _ in many:
        head = len(f"FAIL  check_0000 — {'é' * 100}\n".encode())
        if used + head > 8192 - 32:
            break
        used += head
        for _ in range(2):
            if used + 11 > 8192 - 32:
                break
            used += 11
        shown += 1
    assert got["shown"] == shown


def test_explain(spark, results):
    suite = Suite([orders(1)], [Check("slow", "q1", warn="x"), Check('bad"one', "q2", warn="x"), Check("broken", "q3", fail="x")])
    hints = {r["check"]: (r["query"], r["hint"]) for r in res.explain(results, suite_frame(spark, suite)).collect()}
    assert hints['bad"one'] == ("q2", "The `warn` tier fired. 3 row(s) Review the sample rows below and the SQL query.")
    assert hints["broken"][1] == "An ERROR occurred evaluating the check condition: boom"
    assert hints["slow"][1] == "Check passed — no failure to explain."
