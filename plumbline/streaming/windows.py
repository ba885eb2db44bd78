"""Every column rule per closed event-time window, statistical ones included.

The stream is folded to the values of each window: one stateful aggregation by window, column and value. Once the watermark
has passed a window, all its values arrive in one micro-batch with their counts and are judged there by ordinary
aggregations over weighted values: repeats, moments, and ranks for quartiles. Ranks are numbered inside ranges of values and
continued from range to range, so a window with most of the values is spread over tasks as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from plumbline.functions.lineage import discard, materialise
from plumbline.functions.text import NUMERIC
from plumbline.model import ColumnRule
from plumbline.plans.rules import IQR_MIN, NORMAL_MIN, NORMAL_P, ZSCORE_LIMIT, ZSCORE_MIN, Measure, compile_rules, digest_value, missing_columns
from plumbline.streaming.jobs import AVAILABLE_NOW

_STATISTICAL = ("unique", "outliers", "distribution")
_KEY = ["w", "part"]


def _weighed(rules: Sequence[Measure]) -> dict[str, tuple[Measure, bool]]:
    """The columns whose values are kept, by name of their part: digests for uniqueness, numbers for statistics."""
    out = {}
    for m in rules:
        if m.rule == "unique":
            out[f"{m.column}#"] = (m, True)
        elif m.rule in _STATISTICAL and isinstance(m.dtype, NUMERIC):
            out[m.column] = (m, False)
    return out


def window_values(stream: DataFrame, rules: Sequence[ColumnRule], time: str, width: str, delay: str) -> DataFrame:
    """Closed windows ``w`` as ``part, digest, value, n`` and the counts of element-wise rules.

    The part of a window without a name counts its rows; the others hold each value of a column, or its digest, once.
    """
    missing = missing_columns(rules, stream.schema, "window")
    if missing:
        raise ValueError("; ".join(missing.values()))
    measures = compile_rules(rules, stream.schema)
    plain = [m for m in measures if m.rule not in _STATISTICAL]
    broken = [F.when(m.counted_rows(), 1).otherwise(0).alias(m.key) for m in plain]
    none, number = F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("double").alias("value")
    parts = [F.struct(F.lit("").alias("part"), none, number)]
    for name, (m, hashed) in _weighed(measures).items():
        parts.append(F.struct(F.lit(name).alias("part"), (digest_value(m) if hashed else F.lit(None).cast("binary")).alias("digest"), (F.lit(None).cast("double") if hashed else m.number).alias("value")))
    rows = stream.withWatermark(time, delay).select(F.col(time).alias("_time"), *broken, F.explode(F.array(*parts)).alias("p"))
    rows = rows.select("_time", *[m.key for m in plain], "p.*").where("part = '' OR digest IS NOT NULL OR value IS NOT NULL")
    grouped = rows.groupBy(F.window("_time", width).alias("w"), "part", "digest", "value")
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[F.sum(m.key).alias(m.key) for m in plain])


def _ranked(values: DataFrame) -> tuple[DataFrame, str]:
    """Weighted values with ``before``, how many values of their window and part are smaller; and where they are kept."""
    placed, path = materialise(values.repartitionByRange(*_KEY, "value").withColumn("range", F.spark_partition_id()))
    sums = placed.groupBy(*_KEY, "range").agg(F.sum("n").alias("held"))
    along = Window.partitionBy(*_KEY).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("held").over(along), F.lit(0))).drop("held")
    inside = Window.partitionBy(*_KEY, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(starts, [*_KEY, "range"]).withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return out, path


def _quartiles(values: DataFrame) -> tuple[DataFrame, str]:
    """Per window and part: ``q1`` and ``q3`` by linear interpolation, and ``m``, the number of values."""
    ranked, path = _ranked(values)
    sizes = values.groupBy(*_KEY).agg(F.sum("n").alias("m"))
    joined = ranked.join(sizes, _KEY)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))

    places = {p: F.lit(p) * (F.col("m") - 1) for p in (0.25, 0.75)}
    picks = [at(f(place)).alias(f"{name}{int(p * 100)}") for p, place in places.items() for name, f in (("low", F.floor), ("high", F.ceil))]
    found = joined.groupBy(*_KEY, "m").agg(*picks)
    share = {p: F.lit(p) * (F.col("m") - 1) - F.floor(F.lit(p) * (F.col("m") - 1)) for p in places}
    q1, q3 = (F.col(f"low{int(p * 100)}") * (1 - s) + F.col(f"high{int(p * 100)}") * s for p, s in share.items())
    return found.select(*_KEY, "m", q1.alias("q1"), q3.alias("q3")), path


def _statistics(values: DataFrame) -> DataFrame:
    """Per window and part: number of values, mean, deviation and the normality test's tail probability."""
    means = values.groupBy(*_KEY).agg(F.sum("n").alias("m"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    d = F.col("value") - F.col("mean")
    powers = [F.sum(F.col("n") * F.pow(d, F.lit(k))).alias(f"s{k}") for k in (2, 3, 4)]
    sums = values.join(means, _KEY).groupBy(*_KEY, "m", "mean", "least", "most").agg(*powers)
    m, var = F.col("m"), F.col("s2") / F.col("m")
    skew, kurt = F.col("s3") / m / F.pow(var, F.lit(1.5)), F.col("s4") / m / (var * var) - 3
    p = F.exp(-(m / 6.0) * (skew * skew + kurt * kurt / 4.0) / 2.0)
    varied = F.col("least") < F.col("most")
    return sums.select(*_KEY, "m", "mean", F.when(varied, F.sqrt(var)).alias("sd"), F.when(varied, p).alias("p"))


def judge_windows(closed: DataFrame, rules: Sequence[ColumnRule], schema_of: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per window of :func:`window_values`, and the tables to discard once it has been written."""
    measures = compile_rules(rules, schema_of.schema)
    plain = [m for m in measures if m.rule not in _STATISTICAL]
    out = closed.where("part = ''").select("w", F.col("n").alias("n_rows"), *[m.key for m in plain])
    for m in plain:
        if m.rule == "null_rate":
            out = out.withColumn(m.key, F.when(F.col(m.key) / F.col("n_rows") > F.lit(float(m.param)), F.col(m.key)).otherwise(F.lit(0)))
    values, paths = closed.where("value IS NOT NULL").select(*_KEY, "value", "n"), []
    picked: dict[str, DataFrame] = {}

    def add(m: Measure, rows: DataFrame, part: str, count: Column, otherwise: int | None) -> None:
        nonlocal out
        own = rows.where(F.col("part") == part).select("w", count.cast("bigint").alias(m.key))
        out = out.join(own, "w", "left")
        if otherwise is not None:
            out = out.withColumn(m.key, F.coalesce(m.key, F.lit(otherwise).cast("bigint")))

    for m in measures:
        if m.rule not in _STATISTICAL:
            continue
        if m.rule == "unique":
            repeats = closed.where("digest IS NOT NULL").groupBy(*_KEY).agg((F.sum("n") - F.count(F.lit(1))).alias("repeats"))
            add(m, picked.setdefault("unique", repeats), f"{m.column}#", F.col("repeats"), 0)
        elif m.rule == "distribution":
            stats = picked.setdefault("statistics", _statistics(values))
            judged = F.when((F.col("m") >= NORMAL_MIN) & F.col("p").isNotNull(), F.when(F.col("p") < NORMAL_P, 1).otherwise(0))
            add(m, stats, m.column, judged, None)
        elif m.param == "zscore":
            stats = picked.setdefault("statistics", _statistics(values)).where((F.col("m") >= ZSCORE_MIN) & (F.col("sd") > 0))
            far = values.join(stats, _KEY).where(F.abs((F.col("value") - F.col("mean")) / F.col("sd")) > ZSCORE_LIMIT).groupBy(*_KEY).agg(F.sum("n").alias("far"))
            add(m, far, m.column, F.col("far"), 0)
        else:
            if "quartiles" not in picked:
                picked["quartiles"], path = _quartiles(values)
                paths.append(path)
            spread = 1.5 * (F.col("q3") - F.col("q1"))
            fenced = values.join(picked["quartiles"].where(F.col("m") >= IQR_MIN), _KEY)
            far = fenced.where((F.col("value") < F.col("q1") - spread) | (F.col("value") > F.col("q3") + spread)).groupBy(*_KEY).agg(F.sum("n").alias("far"))
            add(m, far, m.column, F.col("far"), 0)
    names = [F.col(m.key).alias(f"{m.column}_{m.rule}") for m in measures]
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_rows", *names), paths


def validate_windows(
    stream: DataFrame, rules: Sequence[ColumnRule], time: str, width: str, delay: str, path: str, checkpoint: str,
    trigger: Mapping[str, Any] = AVAILABLE_NOW,
) -> StreamingQuery:
    """Violations of any rules per tumbling window, written once the watermark has passed it.

    Counts are those of a whole check over the window's rows: repeats for ``unique``, values beyond the fences for
    ``outliers``, 1 or 0 for ``distribution`` and NULL where it cannot be judged (fewer than eight values, or equal ones). A
    replayed micro-batch overwrites its own output. State holds the open windows' distinct values of columns with such rules.
    """
    def record(batch: DataFrame, batch_id: int) -> None:
        closed, kept = materialise(batch)
        paths = [kept]
        try:
            judged, more = judge_windows(closed, rules, stream)
            paths += more
            judged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            for own in paths:
                discard(batch.sparkSession, own)

    values = window_values(stream, rules, time, width, delay)
    return values.writeStream.outputMode("append").foreachBatch(record).option("checkpointLocation", checkpoint).trigger(**trigger).start()
