"""Threshold tiers: SQL conditions over the context of a check's result.

The context is one row with ``row`` (the first result row), ``rows.count``,
``rows.sample`` (the first ten rows) and ``as_of``. Only the parts a condition
mentions are computed, so a plain ``rows.count > 0`` never orders anything.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as ClassicColumn

from plumbline.functions.normalise import type_error_row
from plumbline.functions.text import column, finite, row_json
from plumbline.functions.time import moment, register_functions
from plumbline.model import ERROR, FAIL, PASS, SAMPLE_ROWS, WARN, Check

_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")


def _code(when: str) -> str:
    """The condition with quoted text blanked, lengths kept."""
    return _QUOTED.sub(lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], when)


def mentions(when: str, what: str) -> bool:
    return re.search(rf"(?<![\w.]){what}\b", _code(when), re.IGNORECASE) is not None


def _closing(code: str, opening: int) -> int:
    """Where the bracket at ``opening`` closes, or the end of the text."""
    depth = 0
    for at in range(opening, len(code)):
        depth += (code[at] in "([") - (code[at] in ")]")
        if depth == 0:
            return at
    return len(code)


def _arguments(when: str, code: str, opening: int) -> list[str]:
    """The texts between the commas of a call's brackets."""
    end, depth, cuts = _closing(code, opening), 0, [opening]
    for at in range(opening, end):
        depth += (code[at] in "([") - (code[at] in ")]")
        if code[at] == "," and depth == 1:
            cuts.append(at)
    return [when[a + 1 : b].strip() for a, b in zip(cuts, [*cuts[1:], end], strict=True)]


def typed_ages(ctx: DataFrame, when: str) -> str:
    """The condition with ``age`` of a text spelled ``age_text``."""
    code, out = _code(when), when
    for match in reversed(list(re.finditer(r"\bage\s*\(", code, re.IGNORECASE))):
        argument = _arguments(when, code, match.end() - 1)[0]
        try:
            dtype = ctx.select(F.expr(argument).alias("a")).schema["a"].dataType
        except (AnalysisException, ParseException):
            continue  # the condition as a whole will say what is wrong
        if isinstance(dtype, T.StringType):
            out = out[: match.start()] + "age_text(" + out[match.end() :]
    return out


# Division nodes of a parsed expression, and functions that divide by their second argument, with their signs.
_DIVISIONS = {"Divide": "/", "Remainder": "%", "IntegralDivide": "div", "Pmod": "pmod"}
_DIVIDING = ("mod", "pmod", "div")


def _parts(items) -> list:
    iterator, out = items.iterator(), []
    while iterator.hasNext():
        out.append(iterator.next())
    return out


def _divisions(spark: SparkSession, when: str) -> list[tuple[str, Any]]:
    """Each division of a condition as its sign and the parsed expression it divides by, innermost first."""
    found = []

    def walk(node) -> None:
        children, kind = _parts(node.children()), node.getClass().getSimpleName()
        for child in children:
            walk(child)
        if kind in _DIVISIONS:
            found.append((_DIVISIONS[kind], children[1]))
        elif kind == "UnresolvedFunction" and len(children) == 2 and _parts(node.nameParts())[-1].lower() in _DIVIDING:
            found.append((_parts(node.nameParts())[-1].lower(), children[1]))

    walk(spark._jsparkSession.sessionState().sqlParser().parseExpression(when))
    return found


def divisors(when: str) -> list[tuple[str, str]]:
    """Each ``/``, ``%``, ``div``, ``mod`` or ``pmod`` of a condition with what it divides by, innermost first."""
    return [(sign, expression.sql()) for sign, expression in _divisions(SparkSession.active(), when)]


def _is_zero(spark: SparkSession, expression) -> Column:
    """Whether a parsed expression is zero, as a column that any frame may resolve."""
    return ClassicColumn(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression)).try_cast("double") == F.lit(0.0)


def order_keys(df: DataFrame, order_by: Sequence[str] | None) -> list[Column]:
    return [column(c) for c in order_by or df.columns]


def finite_columns(df: DataFrame) -> list[Column]:
    """All columns, NaN and infinities as NULL: a condition on such a number is an error, neither true nor false."""
    return [finite(column(f.name), f.dataType).alias(f.name) for f in df.schema.fields]


def first_row(df: DataFrame, order_by: Sequence[str] | None = None) -> Column:
    """Aggregate: the first row, found without sorting."""
    return F.min_by(F.struct(*finite_columns(df)), F.struct(*order_keys(df, order_by)))


def first_rows(df: DataFrame, limit: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``limit`` rows; each task keeps only that many."""
    return df.orderBy(*[k.asc_nulls_first() for k in order_keys(df, order_by)]).limit(limit)


def sample_array(df: DataFrame, limit: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row holding the first rows as an array of JSON texts."""
    keys = F.struct(*order_keys(df, order_by))
    head = first_rows(df, limit, order_by).select(keys.alias("k"), row_json(df.schema).alias("json"))
    return head.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "json"))), lambda s: s.getField("json")).alias("sample"))


def context(
    df: DataFrame, order_by: Sequence[str] | None = None, row: bool = True, sample: bool = False, as_of: datetime | None = None
) -> DataFrame:
    """The one-row context conditions are evaluated against."""
    ctx = df.agg(F.count(F.lit(1)).alias("n_rows"), *([first_row(df, order_by).alias("row")] if row else []))
    return add_rows(ctx, df, order_by, sample, as_of)


def add_rows(
    ctx: DataFrame, df: DataFrame, order_by: Sequence[str] | None, sample: bool, as_of: datetime | None
) -> DataFrame:
    parts = [F.col("n_rows").alias("count")]
    if sample:
        keys = F.struct(*order_keys(df, order_by)).alias("k")
        head = first_rows(df, SAMPLE_ROWS, order_by).select(keys, F.struct(*finite_columns(df)).alias("r"))
        rows = F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda s: s.getField("r"))
        parts.append(head.agg(rows.alias("s")).scalar().alias("sample"))
    return ctx.withColumn("rows", F.struct(*parts)).withColumn("as_of", moment(as_of))


def needs(check: Check) -> tuple[bool, bool]:
    """Whether any tier reads ``row``, and whether any reads ``rows.sample``."""
    tiers = [t for t in (check.warn, check.fail) if t]
    return any(mentions(t.when, "row") for t in tiers), any(mentions(t.when, r"rows\s*\.\s*sample") for t in tiers)


def condition(ctx: DataFrame, when: str) -> tuple[Column, Column]:
    """A tier as (error text or NULL, fires).

    Anything but true or false is an error: unknown columns and non-boolean
    conditions are seen from the schema; a NULL outcome, a zero divisor
    anywhere in the text and ``row`` of an empty result at run time.
    """
    none = F.lit(None).cast("string")
    when = typed_ages(ctx, when)
    try:
        dtype = ctx.select(F.expr(when).alias("fires")).schema["fires"].dataType
    except (AnalysisException, ParseException) as err:
        return F.lit(str(err.getMessage() if hasattr(err, "getMessage") else err).splitlines()[0]), F.lit(False)
    if not isinstance(dtype, (T.BooleanType, T.NullType)):
        return F.lit(f"`when` returned {dtype.simpleString()}, expected a boolean"), F.lit(False)
    error = None
    if mentions(when, "row") and "row" in ctx.columns:
        error = F.when(F.col("n_rows") == 0, F.lit("`when` reads `row` but the result has no rows"))
    for sign, expression in _divisions(ctx.sparkSession, when):
        zero = _is_zero(ctx.sparkSession, expression)
        try:
            ctx.select(zero)
        except AnalysisException:  # it speaks of the elements of an array
            return F.lit(f"cannot judge the divisor of `{sign}`: it changes from element to element"), F.lit(False)
        words = F.lit(f"division by zero (`{sign}` with a zero divisor)")
        error = F.when(zero, words) if error is None else error.when(zero, words)
    fires = F.expr(when).cast("boolean")
    null = F.lit("`when` returned null, expected a boolean")
    error = F.when(fires.isNull(), null) if error is None else error.when(fires.isNull(), null)
    return error.otherwise(none), fires


def tier_verdict(ctx: DataFrame, check: Check) -> tuple[Column, Column]:
    """Status and detail: a broken tier is ERROR, else FAIL beats WARN beats PASS."""
    status, detail = None, None
    rows = F.concat(F.col("n_rows").cast("string"), F.lit(" row(s)"))
    for tier, outcome in ((check.fail, FAIL), (check.warn, WARN)):
        if tier is None:
            continue
        error, fires = condition(ctx, tier.when)
        status = (F if status is None else status).when(error.isNotNull(), ERROR).when(fires, outcome)
        detail = (F if detail is None else detail).when(error.isNotNull(), error).when(fires, rows)
    if status is None:
        return F.lit(PASS), rows
    return status.otherwise(PASS), detail.otherwise(rows)


def evaluate(df: DataFrame, check: Check, as_of: datetime | None = None) -> DataFrame:
    """One row: ``check, status, detail, sample`` for a check with tiers.

    Evaluated here, so that a condition or a query that fails while it runs is
    an ERROR like any other.
    """
    failed = type_error_row(df, check.name, ERROR)
    if failed is not None:
        return failed
    register_functions(df.sparkSession, as_of)
    schema = "check string, status string, detail string, sample array<string>"
    try:
        got = tuple(_evaluated(df, check, as_of).first())
    except Exception as err:  # noqa: BLE001 - whatever stops a check is its result
        text = err.getMessage() if hasattr(err, "getMessage") else str(err)
        got = (check.name, ERROR, (text or type(err).__name__).splitlines()[0], [])
    return df.sparkSession.createDataFrame([got], schema)


def _evaluated(df: DataFrame, check: Check, as_of: datetime | None) -> DataFrame:
    row, sample = needs(check)
    ctx = context(df, check.order_by, row, sample, as_of)
    status, detail = tier_verdict(ctx, check)
    out = ctx.select(F.lit(check.name).alias("check"), status.alias("status"), detail.alias("detail"))
    taken = F.array().cast("array<string>")
    for tier, outcome in ((check.fail, FAIL), (check.warn, WARN)):
        if tier is not None and tier.sample:
            rows = sample_array(df, tier.sample, check.order_by).scalar()
            taken = F.when(F.col("status") == outcome, rows).otherwise(taken)
    return out.withColumn("sample", taken)
