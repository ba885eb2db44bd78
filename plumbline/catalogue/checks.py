"""Tiers, whole checks, suites and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalogue.registry import EVENTS_AS_OF, TABLES, Tables, query
from plumbline.catalogue.rules import ORDER_RULES
from plumbline.functions.lineage import fresh_dir
from plumbline.model import Check, ColumnRule, Defaults, Suite, Tier
from plumbline.plans import results as res
from plumbline.plans.suite import run_suite, suite_frame
from plumbline.plans.thresholds import context, evaluate
from plumbline.plans.validate import validate
from plumbline.sources import frame_connection, parquet_connection

NEGATIVE = "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0"
ERROR_RATE = "SELECT count(*) FILTER (WHERE event_type = 'error') / count(*) AS rate FROM events"


def _negative(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal < 0").select("c_custkey", "c_acctbal")


@query(
    "check_context",
    """SELECT n AS n_rows, c_custkey AS first_key, round(c_acctbal, 2) AS first_balance, least(n, 10) AS n_sampled FROM
           (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 1),
           (SELECT count(*) AS n FROM customer WHERE c_acctbal < 0)""",
)
def check_context(t: Tables) -> DataFrame:
    ctx = context(_negative(t), ["c_custkey"], row=True, sample=True, as_of=EVENTS_AS_OF)
    return ctx.select(
        F.col("rows.count").alias("n_rows"), F.col("row.c_custkey").alias("first_key"),
        F.round("row.c_acctbal", 2).alias("first_balance"), F.size("rows.sample").cast("bigint").alias("n_sampled"),
    )


def _evaluated(df: DataFrame, checks: list[Check]) -> DataFrame:
    out = None
    for check in checks:
        line = evaluate(df, check, EVENTS_AS_OF).drop("sample")
        out = line if out is None else out.unionByName(line)
    return out


def _check(name: str, **tiers: object) -> Check:
    return Check(name, query="", **tiers)


@query(
    "tier_eval",
    """SELECT "check", CASE WHEN hit THEN 'FAIL' ELSE 'PASS' END AS status, '1 row(s)' AS detail FROM
           (SELECT 'some_orders' AS "check", n = 0 AS hit FROM (SELECT count(*) AS n FROM orders)
            UNION ALL SELECT 'too_many', n > 100 FROM (SELECT count(*) AS n FROM orders)
            UNION ALL SELECT 'ratio', filled / n > 0.5 FROM (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled FROM orders)
            UNION ALL SELECT 'newest', epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(latest) > 86400 FROM (SELECT max(o_orderdate) AS latest FROM orders))""",
)
def tier_eval(t: Tables) -> DataFrame:
    totals = t.orders.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.max("o_orderdate").alias("latest")
    )
    conditions = {
        "some_orders": "row.n == 0", "too_many": "row.n > 100", "ratio": "row.filled / row.n > 0.5",
        "newest": "age(row.latest) > duration('1d')",
    }
    return _evaluated(totals, [_check(name, fail=when) for name, when in conditions.items()])


@query("tier_error_missing_column", """SELECT 'typo' AS "check", 'ERROR' AS status, count(*) AS n_rows FROM orders""")
def tier_error_missing_column(t: Tables) -> DataFrame:
    checked = evaluate(t.orders.agg(F.count(F.lit(1)).alias("n")), _check("typo", fail="row.m == 0"))
    return checked.select("check", "status").withColumn("n_rows", t.orders.agg(F.count(F.lit(1))).scalar())


@query(
    "tier_error_non_boolean",
    """SELECT 'number' AS "check", 'ERROR' AS status, '`when` returned bigint, expected a boolean' AS detail FROM orders HAVING count(*) > 0
       UNION ALL SELECT 'unknown', 'ERROR', '`when` returned null, expected a boolean' FROM orders HAVING count(*) > 0""",
)
def tier_error_non_boolean(t: Tables) -> DataFrame:
    totals = t.orders.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("o_orderkey") < 0, 1)).alias("none"))
    return _evaluated(totals, [_check("number", fail="row.n + 1"), _check("unknown", fail="row.none > 3")])


@query(
    "tier_error_div_zero",
    """SELECT "check", CASE WHEN zero THEN 'ERROR' ELSE 'PASS' END AS status,
              CASE WHEN zero THEN 'division by zero (`' || sign || '` with a zero divisor)' ELSE '1 row(s)' END AS detail FROM
           (SELECT 'divide' AS "check", '/' AS sign, negative = 0 AS zero FROM (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS negative FROM orders)
            UNION ALL SELECT 'modulo', '%', negative = 0 FROM (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS negative FROM orders)
            UNION ALL SELECT 'whole', 'div', negative = 0 FROM (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS negative FROM orders)
            UNION ALL SELECT 'rest', 'mod', negative = 0 FROM (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS negative FROM orders)
            UNION ALL SELECT 'plain_rest', 'pmod', negative = 0 FROM (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS negative FROM orders)
            UNION ALL SELECT 'untaken', '/', negative = 0 FROM (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS negative FROM orders)
            UNION ALL SELECT name, '/', n = 0 FROM (SELECT count(*) AS n FROM orders),
                (VALUES ('sound'), ('quoted_name'), ('exponent'), ('branches'), ('remark')) c(name)
            UNION ALL SELECT 'branches_zero', '/', negative = 0 FROM (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS negative FROM orders))""",
)
def tier_error_div_zero(t: Tables) -> DataFrame:
    totals = t.orders.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") < 0).alias("negative"), F.lit(1).alias("n/a"))
    conditions = {
        "divide": "row.n / row.negative < 1", "modulo": "row.n % row.negative == 0",
        "whole": "row.n div row.negative == 0", "rest": "mod(row.n, row.negative) == 0", "plain_rest": "pmod(row.n, (row.negative * 1)) == 0",
        "untaken": "row.n < 0 and row.n / (row.negative * 2) > 1", "sound": "row.negative / row.n > 1",
        "quoted_name": "row.`n/a` > 1 and row.n < 0", "exponent": "row.n / 1e-3 < 1", "branches": "row.n / case when row.n > 0 then 2 else 1 end < 0",
        "remark": "row.n % 3 == 7 -- row.n / 0", "branches_zero": "row.n / case when row.n < 0 then 2 else row.negative end < 0",
    }
    return _evaluated(totals, [_check(name, fail=when) for name, when in conditions.items()])


@query(
    "tier_error_nan",
    """SELECT "check", 'ERROR' AS status, '`when` returned null, expected a boolean' AS detail
       FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice > 0), (VALUES ('below'), ('above'), ('sampled')) c("check") WHERE n > 0
       UNION ALL SELECT 'counted', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, '1 row(s)' FROM orders WHERE o_totalprice > 0""",
)
def tier_error_nan(t: Tables) -> DataFrame:
    """A rate that is not a number is neither below nor above a threshold."""
    paid = t.orders.where("o_totalprice > 0")
    totals = paid.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice") * float("nan")).alias("rate"))
    conditions = {"below": "row.rate < 0.9", "above": "row.rate > 0.9", "sampled": "rows.sample[0].rate > 0.9", "counted": "row.n > 0"}
    return _evaluated(totals, [_check(name, fail=when) for name, when in conditions.items()])


@query(
    "suite_frames",
    """SELECT "check", connection, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n || ' row(s)' AS detail FROM (
           SELECT 'first' AS "check", 'a' AS connection, count(*) AS n FROM orders WHERE o_totalprice > 400000
           UNION ALL SELECT 'second', 'b', count(*) FROM customer WHERE c_acctbal < 0
           UNION ALL SELECT 'third', 'a', count(*) FROM orders WHERE o_totalprice > 400000)""",
)
def suite_frames(t: Tables) -> DataFrame:
    """Two connections of frames, each with a table of the same name."""
    pair = [frame_connection("a", {"t": t.orders.where("o_totalprice > 400000")}), frame_connection("b", {"t": t.customer.where("c_acctbal < 0")})]
    checks = [Check(name, "SELECT * FROM t", on=on, fail="rows.count > 0") for name, on in (("first", "a"), ("second", "b"), ("third", "a"))]
    return run_suite(t.spark, Suite(pair, checks), EVENTS_AS_OF).select("check", "connection", "status", "detail")


@query(
    "check_decide",
    """SELECT "check", status, n || ' row(s)' AS detail FROM (SELECT count(*) AS n FROM customer WHERE c_acctbal < 0), LATERAL
           (SELECT 'fail_wins' AS "check", CASE WHEN n > 2 THEN 'FAIL' WHEN n > 1 THEN 'WARN' ELSE 'PASS' END AS status
            UNION ALL SELECT 'warn_only', CASE WHEN n > 1000000000 THEN 'FAIL' WHEN n > 1 THEN 'WARN' ELSE 'PASS' END
            UNION ALL SELECT 'no_tier', 'PASS' UNION ALL SELECT 'neither', 'PASS')
       UNION ALL SELECT 'broken_fail', 'ERROR', '`when` returned int, expected a boolean' FROM customer HAVING count(*) > 0""",
)
def check_decide(t: Tables) -> DataFrame:
    checks = [
        _check("fail_wins", warn="rows.count > 1", fail="rows.count > 2"), _check("warn_only", warn="rows.count > 1", fail="rows.count > 1000000000"),
        _check("no_tier"), _check("neither", warn="rows.count < 0", fail="rows.count < 0"),
        _check("broken_fail", warn="rows.count > 1", fail="1 + 1"),
    ]
    return _evaluated(_negative(t), checks)


@query(
    "check_empty_result",
    """SELECT "check", status, detail FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0), LATERAL
           (SELECT 'counted' AS "check", CASE WHEN n = 0 THEN 'FAIL' ELSE 'PASS' END AS status, n || ' row(s)' AS detail
            UNION ALL SELECT 'first_row', 'ERROR', '`when` reads `row` but the result has no rows'
            UNION ALL SELECT 'masked', 'ERROR', '`when` reads `row` but the result has no rows')""",
)
def check_empty_result(t: Tables) -> DataFrame:
    checks = [
        _check("counted", fail="rows.count == 0"), _check("first_row", fail="row.o_totalprice < 0"),
        _check("masked", fail="rows.count == 0 or row.o_totalprice < 0"),
    ]
    return _evaluated(t.orders.where("o_totalprice < 0"), checks)


@query(
    "check_unsupported_type",
    """SELECT "check", 'ERROR' AS status, 'column "embedding" has unhandled type array<float>' AS detail, n AS n_rows
       FROM (VALUES ('by_tier'), ('by_rule')) c("check"), (SELECT count(*) AS n FROM embeddings)""",
)
def check_unsupported_type(t: Tables) -> DataFrame:
    by_tier = evaluate(t.embeddings, _check("by_tier", fail="rows.count > 0"))
    by_rule = validate(t.embeddings, [ColumnRule("label", not_null=True)], "by_rule")
    both = by_tier.unionByName(by_rule).drop("sample")
    return both.withColumn("n_rows", t.embeddings.agg(F.count(F.lit(1))).scalar())


@query(
    "tier_sample",
    """SELECT 'negative_balance' AS "check", CASE WHEN any_value(n) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
              coalesce(list('{"c_custkey":' || c_custkey || ',"c_acctbal":' || c_acctbal || '}' ORDER BY c_custkey), []) AS sample
       FROM (SELECT c_custkey, c_acctbal, count(*) OVER () AS n FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 5)""",
)
def tier_sample(t: Tables) -> DataFrame:
    check = Check("negative_balance", NEGATIVE, fail=Tier("rows.count > 0", sample=5), order_by=["c_custkey"])
    return evaluate(_negative(t), check).drop("detail")


def shop_suite(root: str) -> Suite:
    """Checks over the test tables that end in every status."""
    shop = parquet_connection("shop", root, ["orders", "customer", "lineitem"])
    feed = parquet_connection("feed", root, ["events"])
    replica = parquet_connection("replica", root, ["no_such_table"])
    rate = Check("error_rate", ERROR_RATE, on="feed", warn="row.rate > 0.1", fail="row.rate > 0.5", on_fail="audit")
    return Suite(
        [shop, feed, replica],
        [
            Check("orders_present", "SELECT count(*) AS n FROM orders", fail="row.n == 0"),
            Check("orders_plausible", "SELECT count(*) AS n FROM orders", warn="row.n > 1000000000"),
            Check("balances", NEGATIVE, fail=Tier("rows.count > 0", sample=3, sustained="2h"), order_by=["c_custkey"]),
            rate,
            Check("orders_valid", "SELECT * FROM orders", validate=ORDER_RULES, order_by=["o_orderkey"]),
            Check("orders_fields", "SELECT * FROM orders", validate=[ColumnRule("o_email", not_null=True)], order_by=["o_orderkey"]),
            Check("replica_lag", "SELECT 1 AS ok", on="replica", fail="row.ok != 1"),
            Check("lost_table", "SELECT * FROM no_such_table", fail="rows.count > 0"),
        ],
        Defaults(every="5m", timeout="10m", on_fail="ops"),
    )


# Fixed value: what the suite above must give, one row per check.
SUITE_SQL = """
    SELECT 0 AS ord, 'orders_present' AS "check", CASE WHEN count(*) = 0 THEN 'FAIL' ELSE 'PASS' END AS status, '1 row(s)' AS detail FROM orders
    UNION ALL SELECT 1, 'orders_plausible', CASE WHEN count(*) > 1000000000 THEN 'WARN' ELSE 'PASS' END, '1 row(s)' FROM orders
    UNION ALL SELECT 2, 'balances', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) || ' row(s)' FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 3, 'error_rate', CASE WHEN r > 0.5 THEN 'FAIL' WHEN r > 0.1 THEN 'WARN' ELSE 'PASS' END, '1 row(s)'
        FROM (SELECT count(*) FILTER (WHERE event_type = 'error') / count(*) AS r FROM events)
    UNION ALL SELECT 4, 'orders_valid', CASE WHEN r + m > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN r + m = 0 THEN n || ' row(s), all rules passed' ELSE
        concat_ws('; ', CASE WHEN r > 0 THEN 'column "o_totalprice": range=[0,400000]: ' || r || ' value(s) out of range' END,
                  CASE WHEN m > 0 THEN 'column "o_orderpriority": matches: ' || m || ' value(s) do not match pattern "^[1-3]-"' END) END
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 400000) AS r,
                     count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')) AS m FROM orders)
    UNION ALL SELECT 5, 'orders_fields', 'ERROR', 'column "o_email" not found in query result (check "orders_fields")' FROM orders HAVING count(*) > 0
    UNION ALL SELECT 6, 'replica_lag', 'ERROR', 'connection "replica" unavailable'
    UNION ALL SELECT 7, 'lost_table', 'ERROR', 'table not found'"""


def _results(t: Tables) -> DataFrame:
    """The suite's results, with engine-specific error texts shortened."""
    out = run_suite(t.spark, shop_suite(t.root), EVENTS_AS_OF)
    detail = F.regexp_replace("detail", '^(connection "replica" unavailable): .*$', "$1")
    detail = F.when(F.contains(detail, F.lit("TABLE_OR_VIEW_NOT_FOUND")), "table not found").otherwise(detail)
    return out.withColumn("detail", detail)


@query("suite_run", SUITE_SQL)
def suite_run(t: Tables) -> DataFrame:
    return _results(t).select("ord", "check", "status", "detail")


@query("suite_dead_source", f"SELECT * FROM ({SUITE_SQL}) WHERE ord IN (2, 3, 6)")
def suite_dead_source(t: Tables) -> DataFrame:
    """Checks of the dead connection are errors; those of the others still run."""
    return _results(t).where(F.col("connection").isin("replica", "feed") | (F.col("check") == "balances")).select(
        "ord", "check", "status", "detail"
    )


@query("check_error_isolated", f"SELECT \"check\", status FROM ({SUITE_SQL}) WHERE ord IN (0, 7)")
def check_error_isolated(t: Tables) -> DataFrame:
    return _results(t).where(F.col("check").isin("orders_present", "lost_table")).select("check", "status")


@query(
    "suite_for_each",
    " UNION ALL ".join(
        f"""SELECT 'not_empty[{t}]' AS "check", CASE WHEN count(*) = 0 THEN 'FAIL' WHEN count(*) < 1000 THEN 'WARN' ELSE 'PASS' END AS status FROM {t}"""
        for t in TABLES
    ),
)
def suite_for_each(t: Tables) -> DataFrame:
    each = Check("not_empty", "SELECT count(*) AS n FROM ${each.value}", for_each=TABLES, fail="row.n == 0", warn="row.n < 1000")
    return run_suite(t.spark, Suite([parquet_connection("all", t.root, TABLES)], [each]), EVENTS_AS_OF).select("check", "status")


@query("results_filter", f"SELECT ord, \"check\", status FROM ({SUITE_SQL}) WHERE status = 'ERROR' ORDER BY ord LIMIT 2")
def results_filter(t: Tables) -> DataFrame:
    return res.results_filter(_results(t), "error", 2).select("ord", "check", "status")


@query(
    "results_health",
    f"""SELECT count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) AS failing,
               CASE WHEN count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) > 0 THEN 503 ELSE 200 END AS http_status FROM ({SUITE_SQL})""",
)
def results_health(t: Tables) -> DataFrame:
    return res.results_health(_results(t))


@query(
    "results_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned,
               count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) AS failed, count(*) FILTER (WHERE status = 'ERROR') AS errored,
               CASE WHEN count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({SUITE_SQL})""",
)
def results_summary(t: Tables) -> DataFrame:
    return res.results_summary(_results(t))


@query(
    "results_gauges",
    f"""SELECT ord, "check", 'check_status' AS metric, CASE status WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END AS value FROM ({SUITE_SQL})
        UNION ALL SELECT ord, "check", 'check_up', CASE WHEN status IN ('PASS', 'WARN') THEN 1 ELSE 0 END FROM ({SUITE_SQL})""",
)
def results_gauges(t: Tables) -> DataFrame:
    return res.results_gauges(_results(t))


_HEAD = """printf('  [%s] %-32s %s', CASE status WHEN 'ERROR' THEN 'ERR ' ELSE status END, "check", detail)"""


# The sample rows the failing checks of the suite carry, as JSON texts in order.
_BALANCE_JSON = """'{"c_custkey":' || c_custkey || ',"c_acctbal":' || c_acctbal || '}'"""
_ORDER_JSON = """'{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":'
    || o_totalprice || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00","o_orderpriority":"' || o_orderpriority || '"}'"""
SAMPLED_SQL = f"""
    SELECT r.*, coalesce(s.sample, []) AS sample FROM ({SUITE_SQL}) r LEFT JOIN (
        SELECT ord, list(j ORDER BY k, key) AS sample FROM (
            (SELECT 2 AS ord, 0 AS k, c_custkey AS key, {_BALANCE_JSON} AS j FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 3)
            UNION ALL (SELECT * FROM (
                (SELECT 4 AS ord, 1 AS k, o_orderkey AS key, {_ORDER_JSON} AS j FROM orders
                 WHERE o_totalprice < 0 OR o_totalprice > 400000 ORDER BY key LIMIT 10)
                UNION ALL (SELECT 4, 2, o_orderkey AS key, {_ORDER_JSON} FROM orders
                 WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-') ORDER BY key LIMIT 10)) ORDER BY k, key LIMIT 10))
        GROUP BY ord) s ON s.ord = r.ord"""
# The same rows as plain texts.
_BALANCE_TEXT = "'c_custkey=' || c_custkey || ' c_acctbal=' || c_acctbal"
_ORDER_TEXT = """'o_orderkey=' || o_orderkey || ' o_custkey=' || o_custkey || ' o_orderstatus=' || o_orderstatus || ' o_totalprice='
    || o_totalprice || ' o_orderdate=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00 o_orderpriority=' || o_orderpriority"""
TEXT_SQL = SAMPLED_SQL.replace(_BALANCE_JSON, _BALANCE_TEXT).replace(_ORDER_JSON, _ORDER_TEXT)
_LINES_SQL = f"""SELECT ord, 0 AS line_no, {_HEAD} AS line FROM ({SUITE_SQL})
        UNION ALL SELECT ord, i::INTEGER, '      ' || sample[i] FROM ({TEXT_SQL}), range(1, 11) n(i) WHERE i <= len(sample)"""
_QUOTED_DETAIL = """replace(detail, '"', chr(92) || '"')"""


@query("report_text", _LINES_SQL)
def report_text(t: Tables) -> DataFrame:
    return res.report_text(_results(t))


@query("report_text_samples", f"SELECT ord, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ({_LINES_SQL}) GROUP BY ord")
def report_text_samples(t: Tables) -> DataFrame:
    """Every check's lines as one text."""
    lines = res.report_text(_results(t)).groupBy("ord").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return lines.select("ord", "n_lines", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


_FAILURES_SQL = f"""SELECT ord, status || '  ' || "check" || ' — ' || detail || chr(10) AS head, ['  ' || x || chr(10) FOR x IN sample[1:2]] AS rows
        FROM ({SAMPLED_SQL}) WHERE status IN ('FAIL', 'ERROR')"""


@query("report_failures", _FAILURES_SQL)
def report_failures(t: Tables) -> DataFrame:
    return res.failure_lines(_results(t)).select("ord", "head", "rows")


@query(
    "report_digest",
    f"""SELECT (SELECT printf('nightly: %d/%d checks FAILED on "shop"', count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')), count(*)) FROM ({SUITE_SQL}))
               || chr(10) || string_agg(head || array_to_string(rows, ''), '' ORDER BY ord) AS digest, count(*)::INTEGER AS shown, 0 AS more
        FROM ({_FAILURES_SQL})""",
)
def report_digest(t: Tables) -> DataFrame:
    return res.failure_digest(_results(t), "nightly", "shop")


@query(
    "report_payload",
    f"""SELECT '{{"config":"shop","status":"' || CASE WHEN count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) > 0 THEN 'fail' ELSE 'pass' END
               || '","total":' || count(*) || ',"failed":' || count(*) FILTER (WHERE status IN ('FAIL', 'ERROR')) || ',"checks":['
               || string_agg('{{"name":"' || "check" || '","status":"' || lower(status) || '","detail":"' || {_QUOTED_DETAIL} || '"}}', ',' ORDER BY ord)
               || ']}}' AS payload FROM ({SUITE_SQL})""",
)
def report_payload(t: Tables) -> DataFrame:
    return res.run_payload(_results(t), "shop")


@query(
    "report_json",
    f"""SELECT ord, '{{"name":"' || "check" || '","status":"' || lower(status) || '","detail":"' || {_QUOTED_DETAIL} || '","sample":['
               || array_to_string(sample, ',') || ']}}' AS json FROM ({SAMPLED_SQL})""",
)
def report_json(t: Tables) -> DataFrame:
    return res.report_json(_results(t))


@query(
    "report_yaml",
    f"""SELECT ord, '- name: "' || "check" || '"' || chr(10) || '  status: "' || lower(status) || '"' || chr(10) || '  detail: "' || {_QUOTED_DETAIL}
               || '"' || chr(10) || CASE WHEN len(sample) = 0 THEN '  sample: []'
                  ELSE '  sample:' || chr(10) || '  - ' || array_to_string(sample, chr(10) || '  - ') END AS yaml FROM ({SAMPLED_SQL})""",
)
def report_yaml(t: Tables) -> DataFrame:
    return res.report_yaml(_results(t))


@query(
    "report_failing_json",
    f"""SELECT '[' || string_agg('{{"name":"' || "check" || '","status":"' || status || '","detail":"' || {_QUOTED_DETAIL} || '"}}', ',' ORDER BY ord)
               || ']' AS failures_json FROM ({SUITE_SQL}) WHERE status IN ('FAIL', 'ERROR')""",
)
def report_failing_json(t: Tables) -> DataFrame:
    return res.failing_json(_results(t))


@query(
    "report_gauge_text",
    f"""SELECT 'plumbline_check_status{{check="' || "check" || '"}} ' || CASE status WHEN 'PASS' THEN 0 WHEN 'WARN' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END AS line
        FROM ({SUITE_SQL})
        UNION ALL SELECT 'plumbline_check_up{{check="' || "check" || '"}} ' || CASE WHEN status IN ('PASS', 'WARN') THEN 1 ELSE 0 END FROM ({SUITE_SQL})
        UNION ALL SELECT unnest(['# HELP plumbline_check_status Check status: 0=pass 1=warn 2=fail 3=error', '# TYPE plumbline_check_status gauge',
                                 '# HELP plumbline_check_up 1 if check is passing or warning, 0 otherwise', '# TYPE plumbline_check_up gauge'])""",
)
def report_gauge_text(t: Tables) -> DataFrame:
    return res.gauge_text(_results(t))


# Fixed value: query and tiers of every check of the suite above.
_LISTED_SQL = f"""
    SELECT * FROM (VALUES
        (0, 'SELECT count(*) AS n FROM orders', ['fail']), (1, 'SELECT count(*) AS n FROM orders', ['warn']), (2, '{NEGATIVE}', ['fail']),
        (3, '{ERROR_RATE.replace("'", "''")}', ['warn', 'fail']), (4, 'SELECT * FROM orders', []), (5, 'SELECT * FROM orders', []),
        (6, 'SELECT 1 AS ok', ['fail']), (7, 'SELECT * FROM no_such_table', ['fail'])) l(ord, query, conditions)"""


@query(
    "report_explain",
    f"""SELECT r.ord, r."check", r.status, r.detail, l.query, r.sample, CASE r.status
            WHEN 'ERROR' THEN 'An ERROR occurred evaluating the check condition: ' || r.detail
            WHEN 'FAIL' THEN 'The `' || CASE WHEN list_contains(l.conditions, 'fail') THEN 'fail' ELSE 'warn' END || '` tier fired. ' || r.detail
                             || ' Review the sample rows below and the SQL query.'
            ELSE 'Check passed — no failure to explain.' END AS hint
        FROM ({SAMPLED_SQL}) r JOIN ({_LISTED_SQL}) l ON l.ord = r.ord""",
)
def report_explain(t: Tables) -> DataFrame:
    return res.explain(_results(t), suite_frame(t.spark, shop_suite(t.root)))


@query(
    "suite_list",
    f"""SELECT r.ord, r."check", r.status, l.query, l.conditions, CASE r."check" WHEN 'error_rate' THEN 'audit' ELSE 'ops' END AS on_fail,
               CASE r."check" WHEN 'balances' THEN 7200 END AS sustained_secs
        FROM ({SUITE_SQL}) r JOIN ({_LISTED_SQL}) l ON l.ord = r.ord""",
)
def suite_list(t: Tables) -> DataFrame:
    """The suite's checks with the latest status of each."""
    listed = suite_frame(t.spark, shop_suite(t.root)).drop("ord", "connection")
    return listed.join(_results(t).select("ord", "check", "status"), "check").select(
        "ord", "check", "status", "query", "conditions", "on_fail", F.col("sustained_secs").cast("int").alias("sustained_secs")
    )


INCREMENTAL_RULES = [
    ColumnRule("o_orderkey", not_null=True, unique=True), ColumnRule("o_custkey", unique=True),
    ColumnRule("o_orderstatus", allowed=["O", "F"]), ColumnRule("o_totalprice", range=(1000, 400_000), outliers="iqr"),
]


@query(
    "suite_incremental",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
            n AS (SELECT count(*) AS n, count(o_orderkey) - count(DISTINCT o_orderkey) AS k, count(o_custkey) - count(DISTINCT o_custkey) AS c, count(o_custkey) AS cn,
                         count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS s, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) AS r,
                         count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS o FROM orders, q)
       SELECT 'orders_grow' AS "check", CASE WHEN k + c + s + r + o > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
              CASE WHEN k + c + s + r + o = 0 THEN n || ' row(s), all rules passed' ELSE concat_ws('; ',
                  CASE WHEN k > 0 THEN 'column "o_orderkey": unique: ' || k || ' duplicate(s) found in ' || n || ' non-null values' END,
                  CASE WHEN c > 0 THEN 'column "o_custkey": unique: ' || c || ' duplicate(s) found in ' || cn || ' non-null values' END,
                  CASE WHEN s > 0 THEN 'column "o_orderstatus": allowed: ' || s || ' value(s) not in allowed set ["O", "F"]' END,
                  CASE WHEN r + o > 0 THEN 'column "o_totalprice": ' END || concat_ws(', ',
                      CASE WHEN r > 0 THEN 'range=[1000,400000]: ' || r || ' value(s) out of range' END,
                      CASE WHEN o > 0 THEN 'outliers=iqr: ' || o || ' outlier(s) found' END)) END AS detail FROM n""",
)
def suite_incremental(t: Tables) -> DataFrame:
    """The orders arrive in two parts; the second run scans the second part only and judges the whole table."""
    root, checks = fresh_dir(t.spark, "grow"), [Check("orders_grow", "SELECT * FROM orders", validate=INCREMENTAL_RULES)]
    suite = Suite([parquet_connection("shop", root, ["orders"])], checks)
    for part in ("o_orderkey % 4 <> 0", "o_orderkey % 4 = 0"):
        t.orders.where(part).write.mode("append").parquet(f"{root}/orders.parquet")
        results = run_suite(t.spark, suite, store=f"{root}/store")
    return results.select("check", "status", "detail")
