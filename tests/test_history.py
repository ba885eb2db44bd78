"""The history of results: runs count once, and only when complete."""

import pytest

from plumbline.functions.commits import Log
from plumbline.sources import sinks


def run(spark, day, status="PASS"):
    rows = [(0, "a", status), (1, "b", "FAIL")]
    return spark.createDataFrame(rows, "ord int, check string, status string").selectExpr("*", f"TIMESTAMP_NTZ '2024-01-{day:02} 06:00:00' AS run_at")


def rows(spark, path):
    return sorted(tuple(r) for r in sinks.read_results(spark, path).select("check", "status", "run_at").collect())


def test_a_run_counts_once(spark, tmp_path):
    path = str(tmp_path / "history")
    assert sinks.append_results(run(spark, 1), path, "one")
    before = rows(spark, path)
    assert not sinks.append_results(run(spark, 1, "WARN"), path, "one")
    assert rows(spark, path) == before and len(before) == 2


def test_a_run_killed_half_way_is_not_seen_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "history")
    sinks.append_results(run(spark, 1), path, "one")

    class Killed(Exception):
        pass

    def dies(folder):
        run(spark, 2).write.parquet(folder)  # files of another layout, without an end
        raise Killed

    with pytest.raises(Killed):
        Log(spark, path).add("two", dies)
    assert len(rows(spark, path)) == 2
    assert sinks.append_results(run(spark, 2), path, "two")
    assert len(rows(spark, path)) == 4


def test_compaction_changes_files_not_rows(spark, tmp_path):
    path = str(tmp_path / "history")
    for day in range(1, 6):
        sinks.append_results(run(spark, day), path, f"day{day}")
    before = rows(spark, path)
    assert sinks.compact_results(spark, path) == 5
    assert rows(spark, path) == before and len(Log(spark, path).runs()) == 1
    assert not sinks.append_results(run(spark, 3), path, "day3")  # replaced, yet known
    sinks.append_results(run(spark, 9), path, "day9")
    sinks.clean_results(spark, path)
    assert len(rows(spark, path)) == 12 and sinks.compact_results(spark, path) == 0
    assert sinks.compact_results(spark, path, everything=True) == 2
    assert len(rows(spark, path)) == 12
    dates = sinks.read_results(spark, path).where("run_date = DATE '2024-01-03'")
    assert dates.count() == 2 and "run_date=2024-01-03" in "".join(dates.inputFiles())


def test_unusable_names_and_empty_histories(spark, tmp_path):
    with pytest.raises(ValueError, match="name"):
        sinks.append_results(run(spark, 1), str(tmp_path), "a/b")
    with pytest.raises(ValueError, match="no complete run"):
        sinks.read_results(spark, str(tmp_path / "none"))
