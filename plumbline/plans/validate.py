"""Evaluate the column rules of a check over its result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.lineage import discard, materialise
from plumbline.functions.normalise import type_error_row
from plumbline.functions.text import column, row_json
from plumbline.model import ERROR, FAIL, PASS, SAMPLE_ROWS, ColumnRule
from plumbline.plans.rules import (
    Measure, Outliers, as_struct, compile_rules, find_fences, first_pass, measure, missing_columns, with_scores,
)


def column_outcomes(rules: Sequence[ColumnRule], measures: Sequence[Measure], missing: dict[int, str]) -> list[tuple[Column, Column]]:
    """Per rule position: (error text or NULL, violation text or NULL)."""
    rows, none = F.col("n_rows"), F.lit(None).cast("string")
    out = []
    for i in range(len(rules)):
        if i in missing:
            out.append((F.lit(missing[i]), none))
            continue
        mine = [m for m in measures if m.ord == i]
        error = F.coalesce(none, *[m.error() for m in mine])
        texts = [F.when(m.violations(rows) > 0, m.detail(rows)) for m in mine]
        joined = F.concat_ws(", ", *texts) if texts else F.lit("")
        out.append((error, F.when(error.isNull() & (joined != ""), joined)))
    return out


def verdict(
    rules: Sequence[ColumnRule], measures: Sequence[Measure], missing: dict[int, str]
) -> tuple[Column, Column, Column]:
    """Status, detail and violated rule positions of a check, read from the one-row counts."""
    outcomes = column_outcomes(rules, measures, missing)
    none = F.lit(None).cast("string")
    error = F.coalesce(none, *[e for e, _ in outcomes])
    violations = F.concat_ws("; ", *[v for _, v in outcomes]) if outcomes else F.lit("")
    rows = F.col("n_rows")
    status = F.when(rows == 0, PASS).when(error.isNotNull(), ERROR).when(violations != "", FAIL).otherwise(PASS)
    detail = (
        F.when(rows == 0, "0 row(s), no violations")
        .when(error.isNotNull(), error)
        .when(violations != "", violations)
        .otherwise(F.concat(rows.cast("string"), F.lit(" row(s), all rules passed")))
    )
    marks = F.array(*[F.when(v.isNotNull(), F.lit(i)) for i, (_, v) in enumerate(outcomes)]).cast("array<int>")
    return status, detail, F.array_compact(marks)


def rule_report(df: DataFrame, rules: Sequence[ColumnRule], check: str = "check") -> DataFrame:
    """One row per column rule: rows seen, violations, status and message."""
    measures = compile_rules(rules, df.schema)
    missing = missing_columns(rules, df.schema, check)
    wide = measure(df, measures, find_fences(df, measures))
    rows = F.col("n_rows")
    lines = [
        F.struct(
            F.lit(i).alias("ord"), F.lit(rules[i].name).alias("column"), F.lit("column").alias("rule"), rows.alias("n_rows"),
            F.lit(0).cast("bigint").alias("violations"), F.when(rows == 0, PASS).otherwise(ERROR).alias("status"),
            F.when(rows > 0, text).alias("detail"),
        )
        for i, text in missing.items()
    ]
    for m in measures:
        count, error = m.violations(rows).cast("bigint"), F.when(rows > 0, m.error())
        status = F.when(error.isNotNull(), ERROR).when(count > 0, FAIL).otherwise(PASS)
        detail = F.when(error.isNotNull(), error).when(count > 0, m.detail(rows))
        lines.append(
            F.struct(
                F.lit(m.ord).alias("ord"), F.lit(m.column).alias("column"), F.lit(m.rule).alias("rule"), rows.alias("n_rows"),
                F.coalesce(count, F.lit(0)).alias("violations"), status.alias("status"), detail.alias("detail"),
            )
        )
    return wide.select(F.inline(F.array(*lines)))


def offending_rows(
    df: DataFrame,
    rules: Sequence[ColumnRule],
    order_by: Sequence[str] | None = None,
    fences: dict[str, Outliers] | None = None,
    limit: int = SAMPLE_ROWS,
    only: Sequence[int] | None = None,
) -> DataFrame:
    """The first offending rows of each column, numbered within the column.

    One scan for all columns: a row stands once for every column it offends,
    and each task passes on only its first ``limit`` rows per column. ``only`` names the rule positions known to be violated; others
    are then not looked at. The result holds at most ``limit`` rows per column.
    """
    measures = [m for m in compile_rules(rules, df.schema) if only is None or m.ord in only]
    outliers = find_fences(df, measures) if fences is None else fences
    scored = [m for m in measures if m.rule == "outliers" and m.param == "zscore" and m.key not in outliers]
    if scored:
        outliers = with_scores(as_struct(first_pass(df, scored)), scored, outliers)
    broken: dict[int, Column] = {}
    for m in measures:
        predicate = m.predicate(outliers.get(m.key, Outliers()))
        if predicate is not None:
            broken[m.ord] = broken[m.ord] | predicate if m.ord in broken else predicate
    row = F.struct(*map(column, df.columns)).alias("row")
    if not broken:
        return df.limit(0).select(F.lit(0).alias("ord"), F.lit(0).alias("pos"), row)
    marks = F.array_compact(F.array(*[F.when(predicate, F.lit(i)) for i, predicate in broken.items()]))
    hits = df.where(reduce(Column.__or__, broken.values())).select(F.explode(marks).alias("ord"), row)
    within = Window.partitionBy("ord").orderBy(*[F.col("row").getField(c).asc_nulls_first() for c in order_by or df.columns])
    return hits.withColumn("pos", F.row_number().over(within)).where(F.col("pos") <= limit).select("ord", "pos", "row")


def sample_json(
    df: DataFrame,
    rules: Sequence[ColumnRule],
    order_by: Sequence[str] | None = None,
    fences: dict[str, Outliers] | None = None,
    only: Sequence[int] | None = None,
) -> DataFrame:
    """One row: the check's sample as an array of JSON texts, in rule order."""
    bad = offending_rows(df, rules, order_by, fences, only=only)
    lines = bad.select("ord", "pos", "row.*").select("ord", "pos", row_json(df.schema).alias("json"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "pos", "json")))
    texts = F.transform(F.slice(ordered, 1, SAMPLE_ROWS), lambda s: s.getField("json"))
    return lines.agg(texts.alias("sample"))


def validate(
    df: DataFrame, rules: Sequence[ColumnRule], check: str = "check", order_by: Sequence[str] | None = None, reuse: bool = False
) -> DataFrame:
    """One row: ``check, status, detail, sample``.

    Evaluated here: the verdict first, and sample rows only of columns it names,
    so a table that passes is not read for them. With ``reuse`` the result is written once and read back, for inputs that
    are themselves costly to compute.
    """
    failed = type_error_row(df, check, ERROR)
    if failed is not None:
        return failed
    df, path = materialise(df) if reuse else (df, None)
    try:
        measures = compile_rules(rules, df.schema)
        fences = find_fences(df, measures)
        status, detail, broken = verdict(rules, measures, missing_columns(rules, df.schema, check))
        got = measure(df, measures, fences).select(status.alias("status"), detail.alias("detail"), broken.alias("broken")).first()
        sample = []
        if got["status"] == FAIL:
            sample = list(sample_json(df, rules, order_by, fences, only=got["broken"]).first()["sample"])
    finally:
        if path is not None:
            discard(df.sparkSession, path)
    schema = "check string, status string, detail string, sample array<string>"
    return df.sparkSession.createDataFrame([(check, got["status"], got["detail"], sample)], schema)
