"""Column rules and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalogue.registry import Tables, query
from plumbline.model import ColumnRule
from plumbline.plans.validate import offending_rows, rule_report, validate


def _report(df: DataFrame, *rules: ColumnRule) -> DataFrame:
    return rule_report(df, rules).drop("ord")


def _rule(table: str, column: str, rule: str, bad: str, words: str) -> str:
    """SQL for one rule's line: ``bad`` counts offenders, ``words`` uses ``violations``."""
    return f"""
        SELECT '{column}' AS "column", '{rule}' AS rule, n_rows, violations,
               CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
               CASE WHEN violations > 0 THEN {words} END AS detail
        FROM (SELECT count(*) AS n_rows, count(*) FILTER (WHERE {bad}) AS violations FROM {table})"""


def _count_words(head: str, tail: str) -> str:
    return f"'{head}' || violations || '{tail}'"


def _type_words(column: str, kind: str) -> str:
    return _count_words(f'column "{column}": type={kind}: ', " value(s) non-conforming")


@query(
    "rule_type_int",
    " UNION ALL ".join([
        _rule("lineitem", "l_extendedprice", "type", "l_extendedprice <> trunc(l_extendedprice)", _type_words("l_extendedprice", "int")),
        _rule("lineitem", "l_quantity", "type", "l_quantity <> trunc(l_quantity)", _type_words("l_quantity", "int")),
        _rule("lineitem", "l_linenumber", "type", "false", _type_words("l_linenumber", "int")),
        _rule("lineitem", "l_returnflag", "type", "l_returnflag IS NOT NULL", _type_words("l_returnflag", "int")),
    ]),
)
def rule_type_int(t: Tables) -> DataFrame:
    columns = ("l_extendedprice", "l_quantity", "l_linenumber", "l_returnflag")
    return _report(t.lineitem, *[ColumnRule(c, type="int") for c in columns])


@query(
    "rule_type_timestamp",
    " UNION ALL ".join([
        _rule(
            """(SELECT CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
                    WHEN 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN chr(10) ELSE '+25:99' END
                    WHEN 'signup' THEN strftime(ts, '%Y-%m-%d')
                    WHEN 'error' THEN strftime(ts, '2024-02-31 %H:%M:%S') ELSE props END AS stamp FROM events)""",
            "stamp", "type",
            "NOT (regexp_full_match(stamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}Z?')"
            " AND try_cast(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP) IS NOT NULL)",
            _type_words("stamp", "timestamp"),
        ),
        _rule("events", "ts", "type", "false", _type_words("ts", "timestamp")),
        _rule("events", "value", "type", "value IS NOT NULL", _type_words("value", "timestamp")),
    ]),
)
def rule_type_timestamp(t: Tables) -> DataFrame:
    stamp = (
        F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_type") == "view", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.element_at(F.array(*map(F.lit, ("", "\n", "+25:99"))), (F.col("event_id") % 3 + 1).cast("int"))))
        .when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_type") == "error", F.date_format("ts", "'2024-02-31' HH:mm:ss"))
        .otherwise(F.col("props"))
    )
    rules = [ColumnRule(c, type="timestamp") for c in ("stamp", "ts", "value")]
    return _report(t.events.select(stamp.alias("stamp"), "ts", "value"), *rules)


@query(
    "rule_type_static",
    " UNION ALL ".join([
        _rule("lineitem", "l_shipdate", "type", "false", _type_words("l_shipdate", "string")),
        _rule("lineitem", "l_quantity", "type", "l_quantity IS NOT NULL", _type_words("l_quantity", "bool")),
        _rule("lineitem", "l_orderkey", "type", "false", _type_words("l_orderkey", "float")),
        _rule("lineitem", "l_linestatus", "type", "l_linestatus IS NOT NULL", _type_words("l_linestatus", "float")),
        _rule("lineitem", "returned", "type", "false", _type_words("returned", "bool")),
    ]),
)
def rule_type_static(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("returned", F.col("l_returnflag") == "R")
    kinds = {"l_shipdate": "string", "l_quantity": "bool", "l_orderkey": "float", "l_linestatus": "float", "returned": "bool"}
    return _report(lines, *[ColumnRule(c, type=k) for c, k in kinds.items()])


_LABELLED = "(SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left")


@query(
    "rule_not_null",
    " UNION ALL ".join([
        _rule(_LABELLED, "quality", "not_null", "quality IS NULL", _count_words('column "quality": not_null: ', " null value(s) found")),
        _rule(_LABELLED, "doc_id", "not_null", "doc_id IS NULL", _count_words('column "doc_id": not_null: ', " null value(s) found")),
    ]),
)
def rule_not_null(t: Tables) -> DataFrame:
    return _report(labelled(t), ColumnRule("quality", not_null=True), ColumnRule("doc_id", not_null=True))


def _null_rate_sql(column: str, limit: float) -> str:
    return f"""
        SELECT '{column}' AS "column", 'null_rate' AS rule, n_rows, CASE WHEN rate > {limit} THEN nulls ELSE 0 END AS violations,
               CASE WHEN rate > {limit} THEN 'FAIL' ELSE 'PASS' END AS status,
               CASE WHEN rate > {limit} THEN printf('column "{column}": null_rate: %.2f%% nulls exceeds threshold %.2f%%',
                                                    rate * 100.0, {limit} * 100.0) END AS detail
        FROM (SELECT count(*) AS n_rows, count(*) FILTER (WHERE {column} IS NULL) AS nulls,
                     count(*) FILTER (WHERE {column} IS NULL) / count(*)::DOUBLE AS rate FROM {_LABELLED})"""


@query("rule_null_rate", _null_rate_sql("quality", 0.25) + " UNION ALL " + _null_rate_sql("toxic", 0.95))
def rule_null_rate(t: Tables) -> DataFrame:
    return _report(labelled(t), ColumnRule("quality", null_rate=0.25), ColumnRule("toxic", null_rate=0.95))


@query(
    "rule_allowed",
    _rule(
        "events", "event_type", "allowed", "event_type NOT IN ('click', 'view', 'signup', 'purchase')",
        _count_words('column "event_type": allowed: ', ' value(s) not in allowed set ["click", "view", "signup", "purchase"]'),
    ),
)
def rule_allowed(t: Tables) -> DataFrame:
    return _report(t.events, ColumnRule("event_type", allowed=["click", "view", "signup", "purchase"]))


@query(
    "rule_matches",
    " UNION ALL ".join([
        _rule("part", "p_brand", "matches", "NOT regexp_matches(p_brand, '^Brand#[0-9]$')",
              _count_words('column "p_brand": matches: ', ' value(s) do not match pattern "^Brand#[0-9]$"')),
        _rule("part", "p_type", "matches", "NOT regexp_matches(p_type, '^(standard|small)', 'i')",
              _count_words('column "p_type": matches: ', ' value(s) do not match pattern "^(?i:standard|small)"')),
        _rule("part", "p_size", "matches", "NOT regexp_matches(p_size::VARCHAR, '^[1-4][0-9]$')",
              _count_words('column "p_size": matches: ', ' value(s) do not match pattern "^[1-4][0-9]$"')),
    ]),
)
def rule_matches(t: Tables) -> DataFrame:
    return _report(t.part, ColumnRule("p_brand", matches="^Brand#[0-9]$"), ColumnRule("p_type", matches="^(?i:standard|small)"), ColumnRule("p_size", matches="^[1-4][0-9]$"))


@query(
    "rule_range",
    " UNION ALL ".join([
        _rule("orders", "o_totalprice", "range", "o_totalprice < 0 OR o_totalprice > 400000",
              _count_words('column "o_totalprice": range=[0,400000]: ', " value(s) out of range")),
        _rule("orders", "o_orderkey", "range", "o_orderkey < 0.5 OR o_orderkey > 1000000000",
              _count_words('column "o_orderkey": range=[0.5,1000000000]: ', " value(s) out of range")),
        _rule("orders", "o_orderstatus", "range", "o_orderstatus IS NOT NULL",
              _count_words('column "o_orderstatus": range=[0,1]: ', " value(s) out of range")),
    ]),
)
def rule_range(t: Tables) -> DataFrame:
    return _report(
        t.orders, ColumnRule("o_totalprice", range=(0, 400_000)), ColumnRule("o_orderkey", range=(0.5, 1_000_000_000)),
        ColumnRule("o_orderstatus", range=(0, 1)),
    )


def _unique_sql(table: str, column: str) -> str:
    return f"""
        SELECT '{column}' AS "column", 'unique' AS rule, n_rows, nn - d AS violations,
               CASE WHEN nn > d THEN 'FAIL' ELSE 'PASS' END AS status,
               CASE WHEN nn > d THEN 'column "{column}": unique: ' || (nn - d) || ' duplicate(s) found in ' || nn || ' non-null values' END AS detail
        FROM (SELECT count(*) AS n_rows, count({column}) AS nn, count(DISTINCT {column}) AS d FROM {table})"""


@query("rule_unique", _unique_sql("lineitem", "l_orderkey") + " UNION ALL " + _unique_sql("lineitem", "l_extendedprice"))
def rule_unique(t: Tables) -> DataFrame:
    return _report(t.lineitem, ColumnRule("l_orderkey", unique=True), ColumnRule("l_extendedprice", unique=True))


def _outlier_sql(table: str, column: str, method: str, bad: str, stats: str) -> str:
    return _rule(
        f"(SELECT * FROM {table}, (SELECT {stats} FROM {table}))", column, "outliers", bad,
        _count_words(f'column "{column}": outliers={method}: ', " outlier(s) found"),
    )


def _iqr_sql(table: str, column: str) -> str:
    stats = f"quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3"
    return _outlier_sql(table, column, "iqr", f"{column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)", stats)


def _zscore_sql(table: str, column: str) -> str:
    stats = f"avg({column}) AS mean, stddev_pop({column}) AS sd"
    return _outlier_sql(table, column, "zscore", f"abs(({column} - mean) / sd) > 3", stats)


@query("rule_outliers_iqr", _iqr_sql("events", "value") + " UNION ALL " + _iqr_sql("events", "user_id"))
def rule_outliers_iqr(t: Tables) -> DataFrame:
    return _report(t.events, ColumnRule("value", outliers="iqr"), ColumnRule("user_id", outliers="iqr"))


@query("rule_outliers_iqr_lines", _iqr_sql("lineitem", "l_extendedprice"))
def rule_outliers_iqr_lines(t: Tables) -> DataFrame:
    return _report(t.lineitem, ColumnRule("l_extendedprice", outliers="iqr"))


@query("rule_outliers_zscore", _zscore_sql("events", "value") + " UNION ALL " + _zscore_sql("events", "user_id"))
def rule_outliers_zscore(t: Tables) -> DataFrame:
    return _report(t.events, ColumnRule("value", outliers="zscore"), ColumnRule("user_id", outliers="zscore"))


def _normal_sql(table: str, column: str) -> str:
    return f"""
        SELECT '{column}' AS "column", 'distribution' AS rule, n_rows,
               CASE WHEN nn >= 8 AND m2 > 0 AND p < 0.05 THEN 1 ELSE 0 END AS violations,
               CASE WHEN nn < 8 OR m2 = 0 THEN 'ERROR' WHEN p < 0.05 THEN 'FAIL' ELSE 'PASS' END AS status,
               'column "{column}": distribution=normal: ' ||
               CASE WHEN nn < 8 THEN 'normality test needs >= 8 non-null values, got ' || nn
                    WHEN m2 = 0 THEN 'all values are identical; cannot compute normality test'
                    WHEN p < 0.05 THEN printf('Jarque-Bera p=%.4f < 0.05 (not normal)', p) END AS detail
        FROM (SELECT *, exp(-(nn / 6.0) * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) / 2) AS p
              FROM (SELECT count(*) AS n_rows, count(x) AS nn, avg((x - mu) ** 2) AS m2, avg((x - mu) ** 3) AS m3, avg((x - mu) ** 4) AS m4
                    FROM (SELECT {column}::DOUBLE AS x, avg({column}::DOUBLE) OVER () AS mu FROM {table})))"""


_DAILY = "(SELECT avg(value) AS mean_value, count(*) AS n_events, 1 AS one FROM events GROUP BY date_trunc('day', ts))"


@query(
    "rule_distribution_normal",
    " UNION ALL ".join([_normal_sql(_DAILY, "mean_value"), _normal_sql(_DAILY, "n_events"), _normal_sql(_DAILY, "one")]),
)
def rule_distribution_normal(t: Tables) -> DataFrame:
    daily = t.events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n_events"), F.lit(1).alias("one")
    )
    return _report(daily, *[ColumnRule(c, distribution="normal") for c in ("mean_value", "n_events", "one")])


@query(
    "rule_distribution_raw",
    " UNION ALL ".join([_normal_sql("lineitem", "l_extendedprice"), _normal_sql("lineitem", "l_quantity")]),
)
def rule_distribution_raw(t: Tables) -> DataFrame:
    return _report(t.lineitem, *[ColumnRule(c, distribution="normal") for c in ("l_extendedprice", "l_quantity")])


@query(
    "rule_missing_column",
    """SELECT 'orders_fields' AS "check", 'ERROR' AS status,
              'column "o_email" not found in query result (check "orders_fields")' AS detail, count(*) AS n_rows
       FROM orders""",
)
def rule_missing_column(t: Tables) -> DataFrame:
    rules = [ColumnRule("o_email", not_null=True), ColumnRule("o_totalprice", range=(0, 400_000))]
    out = validate(t.orders, rules, "orders_fields").drop("sample")
    return out.withColumn("n_rows", t.orders.agg(F.count(F.lit(1))).scalar())


@query(
    "rule_empty_pass",
    """SELECT 'no_such_orders' AS "check", 'PASS' AS status, '0 row(s), no violations' AS detail
       FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 0) WHERE n = 0""",
)
def rule_empty_pass(t: Tables) -> DataFrame:
    rules = [ColumnRule("o_email", not_null=True), ColumnRule("o_totalprice", range=(0, 1))]
    return validate(t.orders.where("o_totalprice < 0"), rules, "no_such_orders").drop("sample")


@query(
    "validate_detail",
    """SELECT 'order_prices' AS "check", CASE WHEN coalesce(a, b, c) IS NULL THEN 'PASS' ELSE 'FAIL' END AS status,
              concat_ws(', ', a, b, c) AS detail
       FROM (SELECT CASE WHEN t > 0 THEN 'column "o_totalprice": type=int: ' || t || ' value(s) non-conforming' END AS a,
                    CASE WHEN r > 0 THEN 'column "o_totalprice": range=[0,400000]: ' || r || ' value(s) out of range' END AS b,
                    CASE WHEN nn > d THEN 'column "o_totalprice": unique: ' || (nn - d) || ' duplicate(s) found in ' || nn || ' non-null values' END AS c
             FROM (SELECT count(*) FILTER (WHERE o_totalprice <> trunc(o_totalprice)) AS t,
                          count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 400000) AS r,
                          count(o_totalprice) AS nn, count(DISTINCT o_totalprice) AS d FROM orders))""",
)
def validate_detail(t: Tables) -> DataFrame:
    rules = [ColumnRule("o_totalprice", type="int", not_null=True, range=(0, 400_000), unique=True)]
    return validate(t.orders, rules, "order_prices", ["o_orderkey"]).drop("sample")


ORDER_RULES = [
    ColumnRule("o_orderstatus", allowed=["O", "F", "P"]),
    ColumnRule("o_totalprice", type="float", range=(0, 400_000)),
    ColumnRule("o_orderkey", not_null=True, unique=True),
    ColumnRule("o_orderpriority", matches="^[1-3]-"),
]


@query(
    "validate_check",
    """SELECT 'orders_valid' AS "check", CASE WHEN a IS NULL AND b IS NULL THEN 'PASS' ELSE 'FAIL' END AS status,
              CASE WHEN a IS NULL AND b IS NULL THEN n || ' row(s), all rules passed' ELSE concat_ws('; ', a, b) END AS detail
       FROM (SELECT n, CASE WHEN r > 0 THEN 'column "o_totalprice": range=[0,400000]: ' || r || ' value(s) out of range' END AS a,
                    CASE WHEN m > 0 THEN 'column "o_orderpriority": matches: ' || m || ' value(s) do not match pattern "^[1-3]-"' END AS b
             FROM (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 400000) AS r,
                          count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')) AS m FROM orders))""",
)
def validate_check(t: Tables) -> DataFrame:
    return validate(t.orders, ORDER_RULES, "orders_valid", ["o_orderkey"]).drop("sample")


@query(
    "validate_sample",
    """SELECT ord, pos, o_orderkey, o_totalprice, o_orderpriority FROM (
           SELECT 1 AS ord, row_number() OVER (ORDER BY o_orderkey)::INTEGER AS pos, o_orderkey, o_totalprice, o_orderpriority
           FROM orders WHERE o_totalprice < 0 OR o_totalprice > 400000
           UNION ALL
           SELECT 3, row_number() OVER (ORDER BY o_orderkey)::INTEGER, o_orderkey, o_totalprice, o_orderpriority
           FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-'))
       WHERE pos <= 10""",
)
def validate_sample(t: Tables) -> DataFrame:
    bad = offending_rows(t.orders, ORDER_RULES, ["o_orderkey"])
    return bad.select("ord", "pos", "row.o_orderkey", "row.o_totalprice", "row.o_orderpriority")


@query(
    "validate_sample_json",
    """SELECT coalesce(list('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' ORDER BY o_orderkey), []) AS sample
       FROM (SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-') ORDER BY o_orderkey LIMIT 10)""",
)
def validate_sample_json(t: Tables) -> DataFrame:
    rules = [ColumnRule("o_orderpriority", matches="^[1-3]-")]
    return validate(t.orders.select("o_orderkey", "o_orderpriority"), rules, "priorities", ["o_orderkey"]).select("sample")
