"""Suites from stored partial aggregates: equal to full runs, and only new files are scanned."""

import os
import re

import pytest

from plumbline.model import Check, ColumnRule, Suite
from plumbline.plans.profiles import Profile, source_of
from plumbline.plans.suite import run_suite
from plumbline.sources.connections import open_connections, parquet_connection

RULES = [
    ColumnRule("id", not_null=True, unique=True, type="int"),
    ColumnRule("kind", allowed=["a", "b", "c"], null_rate=0.01, unique=True),
    ColumnRule("price", range=(0, 900), outliers="iqr", unique=True),
    ColumnRule("weight", outliers="zscore", distribution="normal"),
    ColumnRule("level", outliers="iqr", distribution="normal"),
    ColumnRule("nothing", outliers="iqr", null_rate=1.0),
]


def rows(spark, start, n, shift=0.0):
    return spark.range(start, start + n).selectExpr(
        "id", "element_at(array('a', 'b', 'c', NULL, 'z'), cast(pmod(hash(id), 5) + 1 AS int)) AS kind",
        f"CASE WHEN id % 97 = 0 THEN NULL WHEN id % 211 = 0 THEN 5000.5 WHEN id % 13 = 0 THEN double('nan') ELSE pmod(hash(id, 1), 1000) + {shift} END AS price",
        "cast((pmod(hash(id, 2), 1000) + pmod(hash(id, 3), 1000) + pmod(hash(id, 4), 1000)) * CASE WHEN id % 500 = 7 THEN 9 ELSE 1 END AS decimal(12, 2)) AS weight",
        "cast(7.1 AS double) AS level", "cast(NULL AS double) AS nothing",
    )


def suite(root):
    checks = [Check("all", "SELECT * FROM items", validate=RULES, order_by=["id"])]
    checks += [Check(f"only_{r.name}", "SELECT *, id % 7 AS week FROM items WHERE id % 3 <> 1", validate=[r], order_by=["id"]) for r in RULES[:5]]
    checks.append(Check("grouped", "SELECT kind, count(*) AS n FROM items GROUP BY kind", validate=[ColumnRule("n", range=(0, 10))]))
    return Suite([parquet_connection("shop", root, ["items"], "")], checks)


def results(spark, root, store=None):
    return [(r["check"], r["status"], r["detail"], list(r["sample"])) for r in run_suite(spark, suite(root), store=store).collect()]


def test_runs_over_growing_and_shrinking_tables_equal_full_runs(spark, tmp_path):
    root, store = str(tmp_path / "shop"), str(tmp_path / "store")
    items = f"{root}/items"
    rows(spark, 0, 3000).repartition(3).write.parquet(items)
    assert results(spark, root, store) == results(spark, root)
    rows(spark, 2900, 1000, 300.0).repartition(2).write.mode("append").parquet(items)
    rows(spark, 0, 0).write.mode("append").parquet(items)
    assert results(spark, root, store) == results(spark, root)
    os.remove(next(f"{items}/{f}" for f in sorted(os.listdir(items)) if f.startswith("part-00001")))
    for f in os.listdir(items):
        if f.endswith(".crc"):
            os.remove(f"{items}/{f}")
    spark.catalog.clearCache()
    assert results(spark, root, store) == results(spark, root)


def test_only_new_files_are_scanned(spark, tmp_path):
    root = str(tmp_path / "shop")
    rows(spark, 0, 2000).repartition(4).write.parquet(f"{root}/items")

    def profile():
        session = open_connections(spark, [parquet_connection("shop", root, ["items"], "")])[0]["shop"]
        query = lambda s: s.sql("SELECT * FROM items")
        return Profile(session, str(tmp_path / "store"), query, source_of(query(session)), RULES)

    old = set(spark.read.parquet(f"{root}/items").inputFiles())
    assert profile().update() == 4 and profile().update() == 0
    rows(spark, 2000, 500).repartition(2).write.mode("append").parquet(f"{root}/items")
    own = profile()
    asked = []
    wrapped = own._rows
    own._rows = lambda files: asked.append(wrapped(files)) or asked[-1]
    assert own.evaluate().scanned == 2
    assert len(asked[0].inputFiles()) == 2 and not old & set(asked[0].inputFiles())
    before = profile().evaluate()
    assert own.compact() == 2 and profile().evaluate() == before and before.scanned == 0


@pytest.mark.parametrize(("sql", "fits"), [
    ("SELECT * FROM items", True), ("SELECT id + 1 AS id FROM (SELECT * FROM items) t WHERE price > 3", True),
    ("SELECT count(*) AS n FROM items", False), ("SELECT * FROM items LIMIT 5", False), ("SELECT DISTINCT kind FROM items", False),
    ("SELECT a.id FROM items a JOIN items b ON a.id = b.id", False), ("SELECT * FROM items WHERE id > rand()", False),
    ("SELECT *, current_date() AS d FROM items", False), ("SELECT * FROM items WHERE id IN (SELECT id FROM items)", False),
    ("SELECT *, row_number() OVER (ORDER BY id) AS n FROM items", False), ("SELECT 1 AS id", False),
])
def test_queries_that_qualify(spark, tmp_path, sql, fits):
    rows(spark, 0, 10).write.parquet(f"{tmp_path}/items")
    session = open_connections(spark, [parquet_connection("shop", str(tmp_path), ["items"], "")])[0]["shop"]
    assert (source_of(session.sql(sql)) is not None) == fits


def test_another_rule_or_query_has_a_profile_of_its_own(spark, tmp_path):
    rows(spark, 0, 100).write.parquet(f"{tmp_path}/shop/items")
    session = open_connections(spark, [parquet_connection("shop", f"{tmp_path}/shop", ["items"], "")])[0]["shop"]

    def of(sql, rules):
        df = session.sql(sql)
        return Profile(session, "store", lambda s: s.sql(sql), source_of(df), rules).log.root

    roots = {of("SELECT * FROM items", RULES), of("SELECT * FROM items", RULES[:2]), of("SELECT * FROM items WHERE id > 4", RULES), of("SELECT * FROM items WHERE id > 5", RULES), of("SELECT id + 1 AS id, kind FROM items", RULES[:2])}
    assert len(roots) == 5 and of("SELECT * FROM items", RULES) == of("select  *  from items", RULES)
    assert all(re.fullmatch(r"store/[0-9a-f]{32}", r) for r in roots)
