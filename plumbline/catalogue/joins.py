"""Checks across tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalogue.registry import Tables, query, r6
from plumbline.operators import joins


@query(
    "join_orphans",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey
       FROM lineitem l LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) s ON s.s_suppkey = l.l_suppkey
       WHERE s.s_suppkey IS NULL""",
)
def join_orphans(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    return joins.orphans(lines, t.supplier.where("s_acctbal >= 0"), "l_suppkey", "s_suppkey")


@query(
    "join_orphans_null_keys",
    """SELECT e.event_id, e.doc_id FROM
           (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS doc_id FROM events) e
           LEFT JOIN labels l ON l.doc_id = e.doc_id WHERE l.doc_id IS NULL""",
)
def join_orphans_null_keys(t: Tables) -> DataFrame:
    link = F.when(F.col("event_type") != "error", F.col("user_id"))
    return joins.orphans(t.events.select("event_id", link.alias("doc_id")), t.labels, "doc_id", "doc_id")


@query("join_orphan_count", "SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_orphan_count(t: Tables) -> DataFrame:
    return joins.orphan_count(t.orders, t.lineitem, "o_orderkey", "l_orderkey")


@query(
    "join_anti_filtered",
    """SELECT c.c_custkey, c.c_name FROM customer c
       LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 300000
       WHERE o.o_orderkey IS NULL""",
)
def join_anti_filtered(t: Tables) -> DataFrame:
    big = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 300000")
    return joins.orphans(t.customer.select("c_custkey", "c_name"), big, "c_custkey", "o_custkey")


@query(
    "join_orphans_multi",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM lineitem l
       LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p.p_partkey = l.l_partkey
       LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) s ON s.s_suppkey = l.l_suppkey
       WHERE p.p_partkey IS NULL OR s.s_suppkey IS NULL""",
)
def join_orphans_multi(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parents = [
        (t.part.where("p_size > 5"), "l_partkey", "p_partkey"), (t.supplier.where("s_acctbal >= 0"), "l_suppkey", "s_suppkey"),
    ]
    return joins.orphans_of_any(lines, parents)


@query(
    "join_not_exists",
    """SELECT count(*) AS n FROM orders o WHERE o.o_orderstatus IN ('O', 'P') AND NOT EXISTS (
           SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""",
)
def join_not_exists(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'")
    return joins.orphan_count(t.orders.where("o_orderstatus IN ('O', 'P')"), returned, "o_orderkey", "l_orderkey")


@query(
    "join_inner_count",
    """SELECT count(*) AS n FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
       WHERE p.p_type = 'ECONOMY' AND l.l_quantity < 5""",
)
def join_inner_count(t: Tables) -> DataFrame:
    return joins.joined_count(t.lineitem.where("l_quantity < 5"), t.part.where("p_type = 'ECONOMY'"), "l_partkey", "p_partkey")


@query(
    "join_semi_distinct",
    """SELECT DISTINCT c.c_custkey, c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
       WHERE c.c_acctbal < 0 AND o.o_totalprice > 450000""",
)
def join_semi_distinct(t: Tables) -> DataFrame:
    owing, big = t.customer.where("c_acctbal < 0"), t.orders.where("o_totalprice > 450000")
    return joins.with_match(owing, big, owing["c_custkey"] == big["o_custkey"]).select("c_custkey", "c_name")


@query(
    "join_group_limit",
    """SELECT p.p_partkey, p.p_size, count(*) AS n FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey
       GROUP BY p.p_partkey, p.p_size HAVING count(*) > p.p_size""",
)
def join_group_limit(t: Tables) -> DataFrame:
    over = joins.over_limit(t.lineitem, t.part, "l_partkey", "p_partkey", F.col("p_size"))
    return over.select("p_partkey", "p_size", "n")


@query(
    "join_reconcile",
    """SELECT o_orderkey, round(o_totalprice, 2) AS stated, round(coalesce(sum(l_extendedprice), 0), 2) AS actual
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice
       HAVING abs(o_totalprice - coalesce(sum(l_extendedprice), 0)) > 0.005""",
)
def join_reconcile(t: Tables) -> DataFrame:
    off = joins.reconcile(t.orders, t.lineitem, "o_orderkey", "l_orderkey", F.col("o_totalprice"), F.col("l_extendedprice"), 0.005)
    return off.select("o_orderkey", F.round("stated", 2).alias("stated"), F.round("actual", 2).alias("actual"))


@query(
    "join_correlated_total",
    """SELECT o.o_orderkey, round(o.o_totalprice, 2) AS stated FROM orders o
       WHERE abs(o.o_totalprice - (SELECT sum(l.l_extendedprice) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) > 200000""",
)
def join_correlated_total(t: Tables) -> DataFrame:
    off = joins.total_mismatch(
        t.orders, t.lineitem, "o_orderkey", "l_orderkey", F.col("o_totalprice"), F.col("l_extendedprice"), 200_000
    )
    return off.select("o_orderkey", F.round("stated", 2).alias("stated"))


@query(
    "cross_table_diff",
    """SELECT a.n AS n_orders, b.n AS n_ordered, a.n - b.n AS diff, c.spent AS lines_total FROM
           (SELECT count(*) AS n FROM orders) a, (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) b,
           (SELECT round(sum(l_quantity), 6) AS spent FROM lineitem) c""",
)
def cross_table_diff(t: Tables) -> DataFrame:
    ordered = t.lineitem.agg(F.count_distinct("l_orderkey"))
    spent = t.lineitem.agg(r6(F.sum("l_quantity")))
    counts = joins.side_by_side(t.orders.agg(F.count(F.lit(1)).alias("n_orders")), n_ordered=ordered, lines_total=spent)
    return counts.withColumn("diff", F.col("n_orders") - F.col("n_ordered"))
