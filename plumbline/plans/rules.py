"""Column rules as Catalyst expressions.

A rule becomes a *row predicate* (which rows offend), an *aggregate* (how many)
and a *detail text*. All predicates of a check are counted in one pass over the
result; only uniqueness and outliers need a second look, and those are separate
small aggregates read back as scalar subqueries.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.quantiles import fences_in_two_scans
from plumbline.functions.text import (
    INTEGRAL, NUMERIC, TIMESTAMPS, as_number, column, debug_list, plain_number, present, quote, value_text,
)
from plumbline.model import ColumnRule

# Order in which a column's rules are reported, and the
# thresholds of the statistical rules.
RULE_ORDER = ("type", "not_null", "null_rate", "allowed", "matches", "range", "unique", "outliers", "distribution")
IQR_MIN, ZSCORE_MIN, NORMAL_MIN = 4, 3, 8
ZSCORE_LIMIT, NORMAL_P = 3.0, 0.05
FIRST = "_first_pass"
# The text forms accepted as a timestamp.
RFC3339_FORM = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
LOCAL_FORM = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z"


def java_pattern(pattern: str) -> str:
    """The pattern in ``java.util.regex`` spelling.

    ``$`` means the very end of the text, ``.`` excludes only ``\\n``, the
    classes ``\\d \\w \\s \\b`` cover Unicode and so does ``(?i)``.
    """
    out, in_class, i = [], 0, 0
    multiline = "(?m" in pattern
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two.startswith("\\") and len(two) == 2:
            out.append(two)
            i += 2
            continue
        char = pattern[i]
        in_class += (char == "[") - (char == "]" and in_class > 0)
        out.append(r"\z" if char == "$" and not in_class and not multiline else char)
        i += 1
    unicode = any(c in pattern for c in (r"\d", r"\w", r"\s", r"\b", r"\D", r"\W", r"\S", r"\B", "[:"))
    text = "".join(out).replace("(?P<", "(?<")
    text = re.sub(r"\(\?([msxU]*)i([imsxU]*)(?=[-:)])", r"(?\1iu\2", text)
    return ("(?dU)" if unicode else "(?d)") + text


def _is_time_text(text: Column) -> Column:
    """Whether text has an accepted timestamp form and names a real instant."""
    local = F.regexp_replace(F.regexp_replace(text, "[Tt]", " "), r"(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})?\z", "")
    real = F.regexp_replace(local, r":60\z", ":59").try_cast("timestamp_ntz").isNotNull()  # a leap second
    return (text.rlike(RFC3339_FORM) | text.rlike(LOCAL_FORM)) & real


def _breaks_type(col: Column, dtype: T.DataType, expected: str) -> Column:
    number, text = isinstance(dtype, NUMERIC), isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))
    if expected == "int" and number and not isinstance(dtype, INTEGRAL):
        return col.cast("double") != F.rint(col.cast("double"))
    if expected == "timestamp" and text:
        return ~_is_time_text(col)
    temporal = isinstance(dtype, (T.DateType, *TIMESTAMPS))
    conforms = {
        "int": number,
        "float": number,
        "string": text or temporal,
        "bool": isinstance(dtype, T.BooleanType),
        "timestamp": temporal,
    }[expected]
    return F.lit(not conforms)


# The largest numbers of the integer types.
_LARGEST = {T.ByteType: 2**7 - 1, T.ShortType: 2**15 - 1, T.IntegerType: 2**31 - 1, T.LongType: 2**63 - 1}


def _outside(col: Column, dtype: T.DataType, low: float, high: float) -> Column:
    """Whether a number lies outside the bounds, compared in the column's own type.

    Bounds become literals of that type, so the comparison is exact and reaches
    the scan; a bound beyond the type's values excludes nothing.
    """
    if isinstance(dtype, INTEGRAL):
        most = _LARGEST[type(dtype)]
        first = -math.inf if low == -math.inf else math.ceil(low) if math.isfinite(low) else math.inf
        last = math.inf if high == math.inf else math.floor(high) if math.isfinite(high) else -math.inf
        if first > most or last < -most - 1 or first > last:
            return F.lit(True)
        tests = [col < F.lit(first).cast(dtype)] if first > -most - 1 else []
        tests += [col > F.lit(last).cast(dtype)] if last < most else []
        return tests[0] | tests[1] if len(tests) == 2 else tests[0] if tests else F.lit(False)
    if isinstance(dtype, T.DecimalType) and math.isfinite(low) and math.isfinite(high):
        return (col < F.lit(Decimal(repr(low)))) | (col > F.lit(Decimal(repr(high))))
    return ~col.cast("double").between(low, high)


@dataclass(frozen=True)
class Outliers:
    """What an outlier test needs to know: an interval, or count, mean and deviation."""

    fences: tuple[float, float] | None = None
    stats: tuple[Column, Column, Column] | None = None

    def predicate(self, value: Column) -> Column:
        if self.fences is not None:
            return (value < self.fences[0]) | (value > self.fences[1])
        if self.stats is not None:
            n, mean, sd = self.stats
            return (n >= ZSCORE_MIN) & (F.abs((value - mean) / F.when(sd > 0, sd)) > ZSCORE_LIMIT)
        return F.lit(False)


@dataclass(frozen=True)
class Measure:
    """One rule of one column: how to count it and how to word it."""

    ord: int
    column: str
    rule: str
    key: str
    param: object
    dtype: T.DataType

    @property
    def value(self) -> Column:
        return column(self.column)

    def predicate(self, outliers: Outliers | None = None) -> Column | None:
        """True on offending rows; ``None`` for rules that name no rows."""
        col, dtype = self.value, self.dtype
        seen = present(col, dtype)
        if self.rule == "type":
            return seen & _breaks_type(col, dtype, self.param)
        if self.rule == "not_null":
            return ~seen
        if self.rule == "allowed":
            return seen & ~value_text(col, dtype).isin(list(self.param))
        if self.rule == "matches":
            return seen & ~value_text(col, dtype).rlike(java_pattern(self.param))
        if self.rule == "range":
            if not isinstance(dtype, NUMERIC):
                return seen
            return seen & _outside(col, dtype, *self.param)
        if self.rule == "outliers" and isinstance(dtype, NUMERIC):
            return seen & outliers.predicate(col.cast("double"))
        return None

    def counted_rows(self) -> Column:
        """True on the rows that an element-wise rule counts; for ``null_rate`` those without a value."""
        return ~present(self.value, self.dtype) if self.rule == "null_rate" else self.predicate()

    @property
    def number(self) -> Column:
        """The values a statistical rule works on: finite numbers, else NULL."""
        return as_number(self.value, self.dtype) if isinstance(self.dtype, NUMERIC) else F.lit(None).cast("double")

    def aggregates(self) -> list[Column]:
        """Counts and statistics taken in the first pass, named after :attr:`key`."""
        if self.rule == "null_rate":
            return [F.count_if(~present(self.value, self.dtype)).alias(self.key)]
        if self.rule == "distribution":
            number = self.number
            stats = (("n", F.count(number)), ("m2", F.var_pop(number)), ("skew", F.skewness(number)), ("kurt", F.kurtosis(number)))
            return [agg.alias(f"{self.key}_{name}") for name, agg in stats]
        if self.rule == "outliers" and self.param == "zscore":
            number = self.number
            stats = (("n", F.count(number)), ("mean", F.avg(number)), ("sd", F.stddev_pop(number)))
            return [agg.alias(f"{self.key}_{name}") for name, agg in stats]
        if self.rule in ("unique", "outliers"):
            return []
        return [F.count_if(self.predicate()).alias(self.key)]

    def late_aggregates(self, first: Column, outliers: Outliers | None) -> list[Column]:
        """What needs a second pass, knowing the statistics of the first."""
        if self.rule == "outliers":
            predicate = self.predicate(outliers)
            return [(F.lit(0).cast("bigint") if predicate is None else F.count_if(predicate)).alias(self.key)]
        return []

    # What follows reads the one-row result of the passes.

    def violations(self, rows: Column) -> Column:
        count = F.col(self.key)
        if self.rule == "null_rate":
            return F.when(count / rows > F.lit(float(self.param)), count).otherwise(F.lit(0))
        if self.rule == "distribution":
            return F.when(self._too_few() | self._constant(), F.lit(0)).when(self._p() < NORMAL_P, F.lit(1)).otherwise(F.lit(0))
        return count

    def _too_few(self) -> Column:
        return F.col(f"{self.key}_n") < NORMAL_MIN

    def _constant(self) -> Column:
        return F.col(f"{self.key}_m2") == 0

    def _p(self) -> Column:
        """Jarque-Bera tail probability; chi-squared with two degrees is exp(-x/2)."""
        n, skew, kurt = (F.col(f"{self.key}_{k}") for k in ("n", "skew", "kurt"))
        return F.exp(-(n / 6.0) * (skew * skew + kurt * kurt / 4.0) / 2.0)

    def error(self) -> Column:
        """Why the rule cannot be evaluated, NULL when it can."""
        if self.rule != "distribution":
            return F.lit(None).cast("string")
        head = f"column {quote(self.column)}: distribution=normal: "
        few = F.concat(F.lit(head + f"normality test needs >= {NORMAL_MIN} non-null values, got "), F.col(f"{self.key}_n").cast("string"))
        return F.when(self._too_few(), few).when(self._constant(), F.lit(head + "all values are identical; cannot compute normality test"))

    def detail(self, rows: Column) -> Column:
        """The rule's message, for when it is violated."""
        # The wording of every rule's message, here and in ``error``.
        head, count = f"column {quote(self.column)}: ", F.col(self.key)

        def counted(before: str, after: str) -> Column:
            return F.concat(F.lit(head + before), count.cast("string"), F.lit(after))

        if self.rule == "type":
            return counted(f"type={self.param}: ", " value(s) non-conforming")
        if self.rule == "not_null":
            return counted("not_null: ", " null value(s) found")
        if self.rule == "null_rate":
            words = (head + "null_rate: ").replace("%", "%%") + "%.2f%% nulls exceeds threshold %.2f%%"
            return F.format_string(words, count / rows * 100.0, F.lit(float(self.param) * 100.0))
        if self.rule == "allowed":
            return counted("allowed: ", f" value(s) not in allowed set {debug_list(self.param)}")
        if self.rule == "matches":
            return counted("matches: ", f" value(s) do not match pattern {quote(self.param)}")
        if self.rule == "range":
            low, high = map(plain_number, self.param)
            return counted(f"range=[{low},{high}]: ", " value(s) out of range")
        if self.rule == "unique":
            return F.concat(counted("unique: ", " duplicate(s) found in "), F.col(f"{self.key}_n").cast("string"), F.lit(" non-null values"))
        if self.rule == "outliers":
            return counted(f"outliers={self.param}: ", " outlier(s) found")
        words = (head + "distribution=normal: Jarque-Bera p=").replace("%", "%%") + "%.4f < 0.05 (not normal)"
        return F.format_string(words, self._p())


def compile_rules(rules: Sequence[ColumnRule], schema: T.StructType, prefix: str = "m") -> list[Measure]:
    """Every active rule of every column present, in reporting order."""
    types = {f.name: f.dataType for f in schema.fields}
    out = []
    for i, rule in enumerate(rules):
        if rule.name not in types:
            continue
        for j, kind in enumerate(RULE_ORDER):
            param = getattr(rule, kind)
            if param is None or (kind in ("not_null", "unique") and param is False):
                continue
            out.append(Measure(i, rule.name, kind, f"{prefix}{i}_{j}", param, types[rule.name]))
    return out


def missing_columns(rules: Sequence[ColumnRule], schema: T.StructType, check: str) -> dict[int, str]:
    """Error text per rule position whose column the result does not have."""
    return {
        i: f"column {quote(rule.name)} not found in query result (check {quote(check)})"
        for i, rule in enumerate(rules)
        if rule.name not in schema.names
    }


class Fences(dict):
    """``Outliers`` per ``iqr`` rule, and what the two scans that found them told beside: measures by name."""

    known: dict[str, object]
    names: tuple[str, ...]


def find_fences(df: DataFrame, measures: Sequence[Measure]) -> Fences:
    """Interquartile fences per ``iqr`` rule. The two scans this takes evaluate the other rules of ``measures`` as well."""
    wanted = [m for m in measures if m.rule == "outliers" and m.param == "iqr" and isinstance(m.dtype, NUMERIC)]
    out = Fences()
    out.known, out.names = {}, ()
    if not wanted:
        return out
    first = [F.count(F.lit(1)).alias("n_rows"), *[a for m in measures for a in m.aggregates()]]
    scored = [m for m in measures if m.rule == "outliers" and m.param == "zscore"]

    def late(row: Row) -> dict[str, Column]:
        known = {m: Outliers(stats=tuple(F.lit(row[f"{m.key}_{k}"]).cast(t) for k, t in (("n", "bigint"), ("mean", "double"), ("sd", "double")))) for m in scored}
        found = {m.key: m.predicate(known[m]) for m in scored}
        return {k: p for k, p in found.items() if p is not None}

    found = fences_in_two_scans(df, list(dict.fromkeys(m.column for m in wanted)), first, late)
    out.update({m.key: Outliers(fences=found.fences[m.column]) for m in wanted})
    out.known = {**found.first, **found.late, **{m.key: found.beyond[m.column] for m in wanted}}
    out.names = tuple(m.key for m in measures)
    return out


def with_scores(first: Column, measures: Sequence[Measure], fences: dict[str, Outliers]) -> dict[str, Outliers]:
    """The fences plus, per ``zscore`` rule, the statistics of a first pass."""
    out = dict(fences)
    for m in measures:
        if m.rule == "outliers" and m.param == "zscore":
            n, mean, sd = (first.getField(f"{m.key}_{k}") for k in ("n", "mean", "sd"))
            out[m.key] = Outliers(stats=(n, mean, sd))
    return out


def first_pass(df: DataFrame, measures: Sequence[Measure], extra: Sequence[Column] = ()) -> DataFrame:
    """Everything one scan can tell, in one row, with ``n_rows``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[a for m in measures for a in m.aggregates()], *extra)


def as_struct(row: DataFrame) -> Column:
    """A one-row result as a scalar subquery."""
    return row.select(F.struct("*").alias("s")).scalar()


def digest_value(m: Measure) -> Column:
    """A value's 256-bit digest, of one type for columns of any type; equal values have equal digests."""
    value = m.number + F.lit(0.0) if isinstance(m.dtype, (T.FloatType, T.DoubleType)) else m.value
    return F.unhex(F.sha2(value if isinstance(m.dtype, T.BinaryType) else value.cast("string"), 256))


def duplicate_counts(df: DataFrame, m: Measure) -> Column:
    """Repeats among the non-null values of one column, as a scalar struct.

    Grouping by the value first lets every task fold its repeats before the
    shuffle, so one very frequent value stays one row per task.
    """
    value = m.number if isinstance(m.dtype, (T.FloatType, T.DoubleType)) else m.value
    if isinstance(m.dtype, (T.StringType, T.CharType, T.VarcharType)):
        value = F.unhex(F.sha2(value, 256))  # long texts don't travel
    per_value = df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_value.agg(F.struct(total.alias("values"), (total - F.count(F.lit(1))).alias("repeats")).alias("dup")).scalar()


def measure(
    df: DataFrame, measures: Sequence[Measure], fences: dict[str, Outliers], extra: Sequence[Column] = ()
) -> DataFrame:
    """All counts of all measures in one row, with ``n_rows`` and any extra aggregates.

    One scan for most rules. ``zscore`` takes a second scan that reads the first
    one's row as a scalar subquery; uniqueness one each, as its shuffle is by the
    column's values. With ``iqr`` rules, the two scans of :func:`find_fences`
    have answered all rules but uniqueness.
    """
    if getattr(fences, "known", None) and fences.names == tuple(m.key for m in measures):
        return _with_repeats(df, measures, _from_known(df, measures, fences, extra))
    wide = first_pass(df, measures, extra)
    second = [m for m in measures if m.rule == "outliers"]
    if second:
        first = as_struct(wide).alias(FIRST)
        seen = F.col(FIRST)
        known = with_scores(seen, second, fences)
        late = [a for m in second for a in m.late_aggregates(seen, known.get(m.key, Outliers()))]
        wide = df.select("*", first).agg(*late).select("*", first).select("*", f"{FIRST}.*").drop(FIRST)
    return _with_repeats(df, measures, wide)


def _from_known(df: DataFrame, measures: Sequence[Measure], fences: Fences, extra: Sequence[Column]) -> DataFrame:
    """Measures that are known already as one row; only ``extra`` needs another look."""
    silent = [m.key for m in measures if m.rule == "outliers" and m.key not in fences.known]
    values = {**fences.known, **dict.fromkeys(silent, 0)}
    lits = [F.lit(v).cast("double" if isinstance(v, float) or k.endswith(("_m2", "_skew", "_kurt", "_mean", "_sd")) else "bigint").alias(k) for k, v in values.items()]
    return (df.agg(*extra) if extra else df.sparkSession.range(1).drop("id")).select("*", *lits)


def _with_repeats(df: DataFrame, measures: Sequence[Measure], wide: DataFrame) -> DataFrame:
    repeats = []
    for m in measures:
        if m.rule == "unique":
            dup = duplicate_counts(df, m)
            repeats += [dup.getField("repeats").alias(m.key), dup.getField("values").alias(f"{m.key}_n")]
    return wide.select("*", *repeats) if repeats else wide
