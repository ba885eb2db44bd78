"""Pages of text results, coerced by declared types."""

import json

import pytest

from plumbline.model import Check, ColumnRule, Suite
from plumbline.plans.suite import run_suite
from plumbline.sources.pages import paged_connection, read_pages, write_pages

TYPES = [("n", "bigint"), ("x", "double"), ("d", "decimal(10,2)"), ("ok", "boolean"), ("s", "varchar"), ("t", "timestamp")]
COLUMNS = [{"name": n, "type": t} for n, t in TYPES]


def pages(path, *rows_of_pages, columns=COLUMNS):
    path.mkdir(parents=True)
    for k, rows in enumerate(rows_of_pages):
        (path / f"p{k}.json").write_text(json.dumps({"page": k, "columns": columns, "rows": rows}))
    return str(path)


def test_cells_follow_their_types(spark, tmp_path):
    head = [n for n, _ in TYPES]
    first = [head, ["42", "3.5", "1.25", "true", "hi", "2024-01-01"], [None] * 6, ["NaN-ish", "many", "", "TRUE", "", None]]
    path = pages(tmp_path / "r", first, [["-7", "1e3", "-0.5", "false", "42", "x"], ["9999999999999999999", " 1", "2"]], [])
    got = [tuple(r) for r in read_pages(spark, path, unread="unread").collect()]
    assert sorted(got, key=str) == sorted([
        (42, 3.5, 1.25, True, "hi", "2024-01-01", {}), (None,) * 6 + ({},), (None, None, None, None, "", None, {"n": "NaN-ish", "x": "many", "d": "", "ok": "TRUE"}),
        (-7, 1000.0, -0.5, False, "42", "x", {}), (None, None, 2.0, None, None, None, {"n": "9999999999999999999", "x": " 1"}),
    ], key=str)
    assert [f.dataType.simpleString() for f in read_pages(spark, path).schema] == ["bigint", "double", "double", "boolean", "string", "string"]


def test_pages_must_agree(spark, tmp_path):
    path = pages(tmp_path / "r", [["n"], ["1"]], columns=[{"name": "n", "type": "bigint"}])
    (tmp_path / "r" / "other.json").write_text(json.dumps({"page": 1, "columns": [{"name": "m", "type": "bigint"}], "rows": [["2"]]}))
    with pytest.raises(Exception, match="declares other columns"):
        read_pages(spark, path).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no page"):
        read_pages(spark, str(tmp_path / "none"))


def test_a_suite_reads_pages(spark, tmp_path):
    df = spark.range(2500).selectExpr("id AS n", "id / 4 AS x", "CASE WHEN id % 100 = 0 THEN NULL ELSE concat('name ', id) END AS s")
    write_pages(df, f"{tmp_path}/items", {"n": "bigint", "x": "double", "s": "varchar"}, 400)
    assert sorted(map(tuple, read_pages(spark, f"{tmp_path}/items").collect()), key=lambda r: r[0]) == [tuple(r) for r in df.collect()]
    rules = [ColumnRule("n", type="int", unique=True, range=(0, 2499)), ColumnRule("x", type="float"), ColumnRule("s", null_rate=0.01)]
    got = run_suite(spark, Suite([paged_connection("service", str(tmp_path), ["items"])], [Check("all", "SELECT * FROM items", validate=rules)])).first()
    assert (got["status"], got["detail"]) == ("PASS", "2500 row(s), all rules passed")
