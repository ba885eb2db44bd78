"""Freshness, volume, rates, duplicates, filters, schema contracts, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.catalogue.registry import EVENTS_AS_OF, ORDERS_AS_OF, Tables, at, query, r6, sql_at
from plumbline.operators import aggregates as ops
from plumbline.operators import filters, schema, topk
from plumbline.operators.joins import side_by_side

NOW, ORDER_NOW = sql_at(EVENTS_AS_OF), sql_at(ORDERS_AS_OF)


def now() -> Column:
    return at(EVENTS_AS_OF)


def order_now() -> Column:
    return at(ORDERS_AS_OF)


@query("agg_not_empty", "SELECT count(*) AS n FROM lineitem")
def agg_not_empty(t: Tables) -> DataFrame:
    return ops.row_count(t.lineitem)


@query("agg_count_band", "SELECT count(*) AS n, count(*) BETWEEN 1000 AND 20000 AS within FROM orders")
def agg_count_band(t: Tables) -> DataFrame:
    return ops.count_band(t.orders, 1000, 20_000)


@query("agg_recent_volume", f"SELECT count(*) AS n FROM events WHERE ts > {NOW} - INTERVAL 36 HOUR")
def agg_recent_volume(t: Tables) -> DataFrame:
    return ops.row_count(t.events.where(ops.since(F.col("ts"), now(), "36 HOURS")))


@query("agg_freshness", f"SELECT (epoch_us({NOW}) - epoch_us(max(ts))) / 1000000 AS age FROM events WHERE event_type = 'purchase'")
def agg_freshness(t: Tables) -> DataFrame:
    return ops.freshness(t.events.where("event_type = 'purchase'"), "ts", now())


@query(
    "agg_group_freshness",
    f"SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) < {NOW} - INTERVAL 6 HOUR",
)
def agg_group_freshness(t: Tables) -> DataFrame:
    return ops.group_freshness(t.events, "user_id", "ts", now(), "6 HOURS")


@query("agg_oldest_pending", f"SELECT coalesce((epoch_us({NOW}) - epoch_us(min(ts))) / 1000000, 0) AS age FROM events WHERE event_type = 'error' AND value > 200")
def agg_oldest_pending(t: Tables) -> DataFrame:
    pending = (F.col("event_type") == "error") & (F.col("value") > 200)
    return ops.oldest_pending(t.events, pending, "ts", now())


@query("agg_failure_rate", "SELECT round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / nullif(count(*), 0), 6) AS rate FROM events")
def agg_failure_rate(t: Tables) -> DataFrame:
    return ops.rate(t.events, F.col("event_type") == "error").select(r6("rate").alias("rate"))


@query(
    "agg_null_rate",
    "SELECT round(avg(CASE WHEN l.quality IS NULL THEN 1.0 ELSE 0.0 END), 6) AS rate FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def agg_null_rate(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return ops.null_rate(joined, "quality").select(r6("rate").alias("rate"))


@query("agg_dup_keys", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def agg_dup_keys(t: Tables) -> DataFrame:
    return ops.duplicates(t.documents, ["text"])


@query("agg_dup_composite", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg_dup_composite(t: Tables) -> DataFrame:
    return ops.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "agg_dup_filtered",
    "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1",
)
def agg_dup_filtered(t: Tables) -> DataFrame:
    return ops.duplicates(t.orders.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("agg_group_size", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) <> 2")
def agg_group_size(t: Tables) -> DataFrame:
    return ops.group_size_not(t.conversations, ["conv_id"], 2)


@query("agg_dup_count", "SELECT count(*) - count(DISTINCT l_orderkey) AS dups FROM lineitem")
def agg_dup_count(t: Tables) -> DataFrame:
    return ops.duplicate_count(t.lineitem, "l_orderkey")


@query("agg_cardinality", "SELECT count(DISTINCT p_brand) AS n FROM part")
def agg_cardinality(t: Tables) -> DataFrame:
    return ops.cardinality(t.part, "p_brand")


@query("agg_group_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 300")
def agg_group_distinct(t: Tables) -> DataFrame:
    return ops.group_distinct_over(t.lineitem, "l_suppkey", "l_partkey", 300)


@query(
    "agg_velocity_count",
    f"SELECT user_id, count(*) AS n FROM events WHERE ts > {NOW} - INTERVAL 3 DAY GROUP BY user_id HAVING count(*) > 7",
)
def agg_velocity_count(t: Tables) -> DataFrame:
    return ops.velocity_count(t.events.where(ops.since(F.col("ts"), now(), "3 DAYS")), "user_id", 7)


@query(
    "agg_velocity_sum",
    f"""SELECT user_id, round(sum(value), 6) AS total FROM events WHERE ts > {NOW} - INTERVAL 3 DAY AND event_type <> 'error'
        GROUP BY user_id HAVING sum(value) > 400""",
)
def agg_velocity_sum(t: Tables) -> DataFrame:
    recent = t.events.where(ops.since(F.col("ts"), now(), "3 DAYS") & (F.col("event_type") != "error"))
    return ops.velocity_sum(recent, "user_id", F.col("value"), 400).select("user_id", r6("total").alias("total"))


@query("agg_sum_sanity", "SELECT round(coalesce(sum(c_acctbal), 0), 2) AS net FROM customer")
def agg_sum_sanity(t: Tables) -> DataFrame:
    return ops.net_sum(t.customer, F.col("c_acctbal")).select(F.round("net", 2).alias("net"))


@query(
    "agg_sum_ratio",
    """SELECT round(sum(l_extendedprice * l_discount)::DOUBLE
                    / nullif(sum(l_extendedprice * l_discount) + sum(l_extendedprice), 0), 6) AS ratio FROM lineitem""",
)
def agg_sum_ratio(t: Tables) -> DataFrame:
    given = F.col("l_extendedprice") * F.col("l_discount")
    return ops.ratio_of_sums(t.lineitem, given, F.col("l_extendedprice")).select(r6("ratio").alias("ratio"))


@query(
    "agg_max_expr",
    """SELECT round(max(l_extendedprice / nullif(l_discount, 0)), 6) AS ratio, round(a.d, 2) AS max_diff
       FROM lineitem, (SELECT coalesce(max(abs(c_acctbal)), 0) AS d FROM customer) a GROUP BY a.d""",
)
def agg_max_expr(t: Tables) -> DataFrame:
    top = ops.max_ratio(t.lineitem, F.col("l_extendedprice"), F.col("l_discount")).select(r6("ratio").alias("ratio"))
    return side_by_side(top, max_diff=ops.max_abs(t.customer, F.col("c_acctbal")).select(F.round("max_diff", 2)))


@query(
    "agg_avg_lag",
    """SELECT round(coalesce(avg(epoch(l_shipdate) - epoch(o_orderdate)), 0), 3) AS lag
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def agg_avg_lag(t: Tables) -> DataFrame:
    orders, lines = t.orders, t.lineitem
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return ops.mean_lag(joined, "o_orderdate", "l_shipdate").select(F.round("lag", 3).alias("lag"))


@query(
    "agg_day_volume",
    f"SELECT count(*) AS n FROM events WHERE ts >= date_trunc('day', {NOW}) - INTERVAL 1 DAY AND ts < date_trunc('day', {NOW})",
)
def agg_day_volume(t: Tables) -> DataFrame:
    return ops.row_count(t.events.where(ops.on_day(F.col("ts"), F.date_sub(now().cast("date"), 1))))


@query(
    "ratio_two_windows",
    f"""WITH t AS (SELECT count(*) AS c FROM events WHERE ts >= date_trunc('day', {NOW}) - INTERVAL 1 DAY AND ts < date_trunc('day', {NOW})),
             p AS (SELECT count(*) AS c FROM events WHERE ts >= date_trunc('day', {NOW}) - INTERVAL 8 DAY AND ts < date_trunc('day', {NOW}) - INTERVAL 7 DAY)
        SELECT round(t.c::DOUBLE / nullif(p.c, 0), 6) AS ratio FROM t, p""",
)
def ratio_two_windows(t: Tables) -> DataFrame:
    today = now().cast("date")
    latest, before = (ops.on_day(F.col("ts"), F.date_sub(today, d)) for d in (1, 8))
    return ops.count_ratio(t.events, latest, before).select(r6("ratio").alias("ratio"))


@query(
    "ratio_supply_demand",
    """SELECT round(count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 6) AS ratio
       FROM events""",
)
def ratio_supply_demand(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return ops.count_ratio(t.events, kind == "purchase", kind == "view").select(r6("ratio").alias("ratio"))


@query("filter_stuck_rows", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < {ORDER_NOW} - INTERVAL 2000 DAY")
def filter_stuck_rows(t: Tables) -> DataFrame:
    stuck = filters.stuck(t.orders, F.col("o_orderstatus") == "P", "o_orderdate", order_now(), "2000 DAYS")
    return stuck.select("o_orderkey", "o_orderdate")


@query("filter_accepted_values", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def filter_accepted_values(t: Tables) -> DataFrame:
    return filters.not_accepted(t.orders, "o_orderstatus", ["O", "F"]).select("o_orderkey", "o_orderstatus")


@query("filter_value_range", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9900")
def filter_value_range(t: Tables) -> DataFrame:
    return filters.out_of_range(t.customer, "c_acctbal", 0, 9900).select("c_custkey", "c_acctbal")


@query(
    "filter_column_compare",
    "SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount AND l_extendedprice > l_quantity * 3000",
)
def filter_column_compare(t: Tables) -> DataFrame:
    out = filters.column_exceeds(t.lineitem, "l_tax", F.col("l_discount"))
    out = filters.column_exceeds(out, "l_extendedprice", F.col("l_quantity") * 3000)
    return out.select("l_orderkey", "l_linenumber", "l_tax", "l_discount")


@query("filter_future_dated", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > {ORDER_NOW}")
def filter_future_dated(t: Tables) -> DataFrame:
    return filters.future_dated(t.orders, "o_orderdate", order_now()).select("o_orderkey", "o_orderdate")


@query(
    "filter_late_arriving",
    f"""SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_shipdate > {ORDER_NOW} - INTERVAL 60 DAY AND o_orderdate < {ORDER_NOW} - INTERVAL 100 DAY""",
)
def filter_late_arriving(t: Tables) -> DataFrame:
    orders, lines = t.orders, t.lineitem
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    late = filters.late_arriving(joined, "l_shipdate", "o_orderdate", order_now(), "60 DAYS", "100 DAYS")
    return late.select("l_orderkey", "l_linenumber", "l_shipdate")


_LAST_SEEN = "(SELECT c_custkey, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"


@query("filter_stale_or_null", f"SELECT * FROM {_LAST_SEEN} WHERE last_order IS NULL OR last_order < {ORDER_NOW} - INTERVAL 600 DAY")
def filter_stale_or_null(t: Tables) -> DataFrame:
    newest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    seen = t.customer.select("c_custkey").join(newest, "c_custkey", "left")
    return filters.stale_or_null(seen, "last_order", order_now(), "600 DAYS")


@query(
    "filter_blank",
    """SELECT page_id, query FROM (SELECT page_id, CASE WHEN contains(url, 'https') THEN NULL ELSE regexp_extract(url, '[?](.*)$', 1) END AS query FROM pages)
       WHERE query IS NULL OR query = ''""",
)
def filter_blank(t: Tables) -> DataFrame:
    text = F.when(~F.contains("url", F.lit("https")), F.regexp_extract("url", "[?](.*)$", 1))
    return filters.blank(t.pages.select("page_id", text.alias("query")), "query")


@query(
    "filter_expiring",
    f"SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN {ORDER_NOW} AND {ORDER_NOW} + INTERVAL 14 DAY",
)
def filter_expiring(t: Tables) -> DataFrame:
    return filters.expiring(t.lineitem, "l_shipdate", order_now(), "14 DAYS").select("l_orderkey", "l_linenumber", "l_shipdate")


@query(
    "filter_implication",
    "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang = 'en' AND l.quality IS NULL",
)
def filter_implication(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return filters.implication_broken(joined, F.col("lang") == "en", "quality").select("doc_id", "lang")


@query("filter_ilike", "SELECT conv_id, turn FROM conversations WHERE text NOT ILIKE '%THE%'")
def filter_ilike(t: Tables) -> DataFrame:
    return filters.text_search(t.conversations, "text", "%THE%", negate=True).select("conv_id", "turn")


def _schema_sql(table: str, name: str, condition: str) -> str:
    return f"""SELECT (SELECT count(*) FROM information_schema.columns WHERE table_name = '{table}' AND {condition}) AS {name},
                      count(*) AS n_rows FROM {table}"""


@query("schema_column_count", _schema_sql("orders", "n", "true"))
def schema_column_count(t: Tables) -> DataFrame:
    return schema.column_count(t.orders)


@query("schema_required_columns", _schema_sql("lineitem", "present", "column_name IN ('l_orderkey', 'l_partkey', 'l_shipdate', 'l_missing')"))
def schema_required_columns(t: Tables) -> DataFrame:
    return schema.required_present(t.lineitem, ["l_orderkey", "l_partkey", "l_shipdate", "l_missing"])


@query("schema_column_type", _schema_sql("orders", "n", "column_name = 'o_totalprice' AND data_type IN ('DOUBLE', 'FLOAT')"))
def schema_column_type(t: Tables) -> DataFrame:
    return schema.type_matches(t.orders, "o_totalprice", ["double", "float"])


@query("topk_latest", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 1")
def topk_latest(t: Tables) -> DataFrame:
    return topk.nth_latest(t.events, "ts", tie_break=["event_id"]).select("event_id", "ts", "event_type")


@query("topk_offset", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 1 OFFSET 5")
def topk_offset(t: Tables) -> DataFrame:
    return topk.nth_latest(t.events, "ts", 5, ["event_id"]).select("event_id", "ts", "event_type")


