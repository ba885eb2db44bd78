"""Column rules over append-only tables from stored partial aggregates.

A profile keeps, for every file of a table, what the rules need to know of it: counts, moments, how many values lie between
fixed edges, and, where a rule depends on all values at once, the values themselves in an order that lets a few of them be
read (quartiles, outliers) or their digests (uniqueness). A run lists the table's files, scans those it has not seen (by
path, size and modification time), drops what it knew of files that are gone, and merges. Its result is that of a full scan.

Only queries that treat each row by itself qualify: projections and filters, without the clock, over one Parquet table.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.commits import Log
from plumbline.functions.quantiles import values_at_ranks
from plumbline.functions.text import NUMERIC
from plumbline.model import FAIL, ColumnRule
from plumbline.plans.rules import IQR_MIN, ZSCORE_LIMIT, ZSCORE_MIN, Measure, Outliers, compile_rules, digest_value, missing_columns
from plumbline.plans.validate import sample_json, verdict
from plumbline.sources.connections import scoped_session

#: Changes when stored profiles of an earlier form can no longer be read.
FORM = 1
#: Intervals that the values of a column with an outlier rule are counted in.
EDGES = 512
#: Plan nodes that treat each row by itself, and expressions that depend on when they are evaluated.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}
_CLOCK = {"CurrentTimestamp", "CurrentTimestampLike", "CurrentDate", "Now", "LocalTimestamp", "CurrentTime", "CurrentUser", "InputFileName", "InputFileBlockStart", "InputFileBlockLength"}


@dataclass(frozen=True)
class Source:
    """The one table a query reads: its view, where its files lie, and its columns."""

    view: str
    roots: tuple[str, ...]
    schema: T.StructType


def _scala(items) -> list:
    iterator = items.iterator()
    out = []
    while iterator.hasNext():
        out.append(iterator.next())
    return out


def source_of(df: DataFrame) -> Source | None:
    """The table behind a query that treats each row by itself; None for any other query."""
    plan = df._jdf.queryExecution().analyzed()
    view, relation, todo = None, None, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _ROWWISE:
            return None
        for expression in _scala(node.expressions()):
            if not expression.deterministic() or any(e.getClass().getSimpleName().rstrip("$") in _CLOCK for e in _scala(expression.collectLeaves())):
                return None
        if node.getClass().getSimpleName() == "SubqueryAlias":
            view = node.identifier().name()
        if node.getClass().getSimpleName() == "LogicalRelation":
            if relation is not None or "HadoopFsRelation" not in node.relation().getClass().getSimpleName():
                return None
            relation = node.relation()
        todo += _scala(node.children())
    if relation is None or view is None or not _scala(plan.subqueriesAll()) == [] or "ParquetFileFormat" not in relation.fileFormat().getClass().getSimpleName():
        return None
    roots = tuple(str(p) for p in _scala(relation.location().rootPaths()))
    return Source(view, roots, T.StructType.fromJson(json.loads(relation.schema().json())))


def _plain(path: Column) -> Column:
    """One spelling of a file's path: ``input_file_name`` escapes it and writes more slashes."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``file, size, modified`` of the table's files; nothing is read of them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return found.select(_plain(F.col("path")).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


# What a rule's state holds.

_MOMENTS = ("n", "mean", "m2", "m3", "m4", "least", "most")


def _held(m: Measure) -> str:
    """What is stored for a rule: ``count``, ``moments``, ``values`` (with moments) or ``digests``."""
    return {"unique": "digests", "outliers": "values", "distribution": "moments"}.get(m.rule, "count")


def _states(m: Measure) -> list[Column]:
    """Aggregates of one file; moments are taken around the file's own mean."""
    if _held(m) == "digests":
        return []
    if _held(m) == "count":
        return m.aggregates()
    v, n = m.number, F.count(m.number)
    var, sd = F.var_pop(v), F.sqrt(F.var_pop(v))
    third, fourth = F.when(sd > 0, F.skewness(v) * n * var * sd).otherwise(0.0), F.when(sd > 0, (F.kurtosis(v) + 3) * n * var * var).otherwise(0.0)
    parts = (n, F.avg(v), var * n, third, fourth, F.min(v), F.max(v))
    return [part.alias(f"{m.key}_{name}") for name, part in zip(_MOMENTS, parts, strict=True)]


@dataclass(frozen=True)
class Moments:
    """Merged count, mean and central moments of a column."""

    n: int
    mean: float
    var: float
    skew: float
    kurt: float
    least: float
    most: float

    @property
    def sd(self) -> float:
        return self.var**0.5


@dataclass(frozen=True)
class Outcome:
    status: str
    detail: str
    sample: list[str]
    #: Files that this run scanned for the profile.
    scanned: int


class Profile:
    """Stored states of one query and its rules below ``root``."""

    def __init__(self, spark: SparkSession, root: str, query: Callable[[SparkSession], DataFrame], source: Source, rules: Sequence[ColumnRule], check: str = "check", order_by: Sequence[str] | None = None) -> None:
        self.spark, self.query, self.source, self.rules, self.check, self.order_by = spark, query, source, rules, check, order_by
        self.whole = query(spark)
        self.measures = compile_rules(rules, self.whole.schema)
        plan = self.whole._jdf.queryExecution().optimizedPlan().canonicalized().expressions().toString()
        said = json.dumps([FORM, source.view, source.roots, source.schema.json(), self.whole.schema.json(), plan, [repr(m) for m in self.measures]])
        self.log = Log(spark, f"{root.rstrip('/')}/{hashlib.sha256(said.encode()).hexdigest()[:32]}")
        self.valued = [m for m in self.measures if _held(m) == "values" and isinstance(m.dtype, NUMERIC)]
        self.digested = [m for m in self.measures if _held(m) == "digests"]

    # Reading and writing the store.

    def _table(self, name: str) -> DataFrame | None:
        folders = [f"{f}/{name}" for f in self.log.folders() if not f.endswith("run=edges")]
        return self.spark.read.parquet(*folders) if folders else None

    def _rows(self, files: Sequence[str]) -> DataFrame:
        """The query over some of the table's files; over its own view if none are named."""
        if not files:
            return self.whole
        session = scoped_session(self.spark)
        reader = session.read.schema(self.source.schema)
        roots = self.source.roots
        if len(roots) == 1 and all(f.startswith(roots[0].rstrip("/") + "/") for f in files):
            reader = reader.option("basePath", roots[0])
        reader.parquet(*files).createOrReplaceTempView(self.source.view)
        return self.query(session)

    def _edges(self, rows: DataFrame) -> dict[str, list[float]]:
        """Bounds that values are counted between, by column; set once, from the first rows seen."""
        def write(folder: str) -> None:
            shares = F.array(*[F.lit(k / EDGES) for k in range(1, EDGES)])
            columns = {m.column: m.number for m in self.valued}
            some = [F.count(v).alias(f"n{k}") for k, v in enumerate(columns.values())]
            asked = [F.kll_sketch_agg_double(v, F.lit(4096)).alias(f"s{k}") for k, v in enumerate(columns.values())]
            one = rows.agg(*some, *asked)
            lines = [
                F.struct(F.lit(c).alias("column"), F.when(F.col(f"n{k}") > 0, F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double(F.col(f"s{k}"), shares)))).otherwise(F.array()).alias("edges"))
                for k, c in enumerate(columns)
            ]
            one.select(F.inline(F.array(*lines))).write.mode("overwrite").parquet(folder)

        self.log.add("edges", write)
        return {r["column"]: list(r["edges"]) for r in self.spark.read.parquet(self.log.folder("edges")).collect()}

    def _add(self, fresh: DataFrame, rows: DataFrame) -> None:
        """Store the states of files: ``rows`` are theirs, ``fresh`` names them."""
        file = F.regexp_replace(F.url_decode(F.regexp_replace(F.input_file_name(), r"\+", "%2B")), "^([A-Za-z0-9+.-]+):/+", "$1:/")
        named = rows.select("*", file.alias("_file"))
        states = named.groupBy("_file").agg(F.count(F.lit(1)).alias("n_rows"), *[a for m in self.measures for a in _states(m)])
        states = fresh.join(states, F.col("file") == F.col("_file"), "left").drop("_file")

        def write(folder: str) -> None:
            states.write.mode("overwrite").parquet(f"{folder}/states")
            if self.valued:
                edges = self._edges(rows)
                columns = {m.column: m.number for m in self.valued}
                numbers = named.select("_file", *[v.alias(f"v{k}") for k, v in enumerate(columns.values())])
                for k, c in enumerate(columns):
                    if edges[c]:
                        splits = [-float("inf"), *edges[c], float("inf")]
                        numbers = Bucketizer(splits=splits, inputCol=f"v{k}", outputCol=f"b{k}", handleInvalid="keep").transform(numbers)
                    else:
                        numbers = numbers.withColumn(f"b{k}", F.lit(0.0))
                each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b{k}").cast("int").alias("bin"), F.col(f"v{k}").alias("value")) for k, c in enumerate(columns)])
                values = numbers.select(F.col("_file").alias("file"), F.inline(each)).where("value IS NOT NULL")
                values.repartitionByRange("column", "value").sortWithinPartitions("column", "value").write.mode("overwrite").parquet(f"{folder}/values")
                kept = self.spark.read.parquet(f"{folder}/values")
                kept.groupBy("file", "column", "bin").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/bins")
            if self.digested:
                each = F.array(*[F.struct(F.lit(m.key).alias("key"), digest_value(m).alias("digest")) for m in self.digested])
                named.select(F.col("_file").alias("file"), F.inline(each)).where("digest IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/digests")

        self.log.add(f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}", write)

    def compact(self, everything: bool = False) -> int:
        """Put the runs added since the last time (or ``everything``) together, without files that are gone; how many runs."""
        small = [r for r in self.log.runs() if r != "edges" and (everything or not r.startswith("merged-"))]
        if len(small) < 2:
            return 0
        live = list_files(self.spark, self.source.roots)

        def write(folder: str) -> None:
            for name, there in (("states", True), ("values", self.valued), ("bins", self.valued), ("digests", self.digested)):
                if there:
                    rows = self.spark.read.parquet(*[f"{self.log.folder(r)}/{name}" for r in small])
                    rows = rows.join(live, ["file", "size", "modified"] if name == "states" else ["file"], "left_semi")
                    rows = rows.repartitionByRange("column", "value").sortWithinPartitions("column", "value") if name == "values" else rows.hint("rebalance")
                    rows.write.mode("overwrite").parquet(f"{folder}/{name}")

        self.log.add(f"merged-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}", write, small)
        return len(small)

    # A run.

    def update(self) -> int:
        """Scan the files not seen yet; how many there were."""
        now = list_files(self.spark, self.source.roots)
        known = self._table("states")
        if known is None:
            n = now.count()
            if n:
                self._add(now, self.whole)
            return n
        fresh = now.join(known.select("file", "size", "modified"), ["file", "size", "modified"], "left_anti")
        files = [r["file"] for r in fresh.select("file").collect()]
        if files:
            self._add(fresh, self._rows(files))
        return len(files)

    def evaluate(self) -> Outcome:
        """Bring the profile up to date, and judge the table by it."""
        scanned = self.update()
        states = self._table("states")
        live = list_files(self.spark, self.source.roots)
        if states is None:
            return self._judge({"n_rows": 0}, {}, scanned, None)
        total = states.count()
        states = states.join(live, ["file", "size", "modified"], "left_semi")
        gone = total > states.count()
        counts = [m for m in self.measures if _held(m) == "count"]
        wide: dict[str, object] = {k: v or 0 for k, v in states.agg(F.sum("n_rows").alias("n_rows"), *[F.sum(m.key).alias(m.key) for m in counts]).first().asDict().items()}
        moments = self._moments(states)
        outliers: dict[str, Outliers] = {}
        for m in self.measures:
            if m.rule == "distribution":
                own = moments[m.key]
                wide.update({f"{m.key}_n": own.n, f"{m.key}_m2": own.var, f"{m.key}_skew": own.skew, f"{m.key}_kurt": own.kurt})
        if self.valued:
            values, bins = self._of(self._table("values"), states, gone), self._of(self._table("bins"), states, gone)
            filled: dict[str, dict[int, int]] = {}
            for r in bins.groupBy("column", "bin").agg(F.sum("n").alias("n")).collect():
                filled.setdefault(r["column"], {})[r["bin"]] = r["n"]
            edges = self._edges(self.whole)
            for m in self.valued:
                own = moments[m.key], values, filled.get(m.column, {}), edges.get(m.column, [])
                outliers[m.key], bounds = self._fences(m, *own)
                wide[m.key] = self._beyond(m, outliers[m.key], bounds, *own)
        if self.digested:
            per_value = self._of(self._table("digests"), states, gone).groupBy("key", "digest").agg(F.count("*").alias("n"))
            seen = {r["key"]: (r["n"], r["d"]) for r in per_value.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
            for m in self.digested:
                n, distinct = seen.get(m.key, (0, 0))
                wide.update({m.key: n - distinct, f"{m.key}_n": n})
        return self._judge(wide, outliers, scanned, states)

    def _of(self, rows: DataFrame, states: DataFrame, gone: bool) -> DataFrame:
        """Rows of files that are still there."""
        return rows.join(states.select("file"), "file", "left_semi") if gone else rows

    def _moments(self, states: DataFrame) -> dict[str, Moments]:
        wanted = [m for m in self.measures if _held(m) in ("moments", "values")]
        if not wanted:
            return {}
        firsts = [a for m in wanted for a in (F.sum(f"{m.key}_n").alias(f"{m.key}_n"), (F.sum(F.col(f"{m.key}_n") * F.col(f"{m.key}_mean")) / F.sum(f"{m.key}_n")).alias(f"{m.key}_mean"), F.min(f"{m.key}_least").alias(f"{m.key}_least"), F.max(f"{m.key}_most").alias(f"{m.key}_most"))]
        first = states.agg(*firsts).first()
        sums = []
        for m in wanted:
            k, n = m.key, F.col(f"{m.key}_n")
            d = F.col(f"{k}_mean") - F.lit(first[f"{k}_mean"] or 0.0)
            m2, m3, m4 = (F.col(f"{k}_{p}") for p in ("m2", "m3", "m4"))
            sums += [
                F.sum(m2 + n * d * d).alias(f"{k}_m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias(f"{k}_m3"),
                F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias(f"{k}_m4"),
            ]
        second = states.agg(*sums).first()
        out = {}
        for m in wanted:
            n = first[f"{m.key}_n"] or 0
            flat = not n or first[f"{m.key}_least"] == first[f"{m.key}_most"]
            m2, m3, m4 = (0.0 if flat else second[f"{m.key}_{p}"] or 0.0 for p in ("m2", "m3", "m4"))
            out[m.key] = Moments(n, first[f"{m.key}_mean"] or 0.0, m2 / n if n else 0.0, n**0.5 * m3 / m2**1.5 if m2 else 0.0, n * m4 / (m2 * m2) - 3 if m2 else 0.0, first[f"{m.key}_least"] or 0.0, first[f"{m.key}_most"] or 0.0)
        return out

    @staticmethod
    def _span(values: DataFrame, column: str, edges: list[float], bin_: int) -> DataFrame:
        """Values of one interval; bounds reach the sorted files."""
        own = values.where(F.col("column") == column)
        if bin_ > 0:
            own = own.where(F.col("value") >= edges[bin_ - 1])
        return own.where(F.col("value") < edges[bin_]) if bin_ < len(edges) else own

    def _fences(self, m: Measure, own: Moments, values: DataFrame, filled: dict[int, int], edges: list[float]) -> tuple[Outliers, tuple[float, float] | None]:
        """An outlier rule's test, and the bounds beyond which it holds (None: nowhere)."""
        if m.param == "zscore":
            test = Outliers(stats=(F.lit(own.n), F.lit(own.mean), F.lit(own.sd)))
            return test, (own.mean - ZSCORE_LIMIT * own.sd, own.mean + ZSCORE_LIMIT * own.sd) if own.n >= ZSCORE_MIN and own.sd > 0 else None
        if own.n < IQR_MIN:
            return Outliers(), None
        places = {p: p * (own.n - 1) for p in (0.25, 0.75)}
        ranks = {r for at in places.values() for r in (math.floor(at), math.ceil(at))}
        found: dict[int, float] = {}
        before = 0
        for b in sorted(filled):
            mine = {r: r - before for r in ranks if before <= r < before + filled[b]}
            if mine:
                found.update(values_at_ranks(self._span(values, m.column, edges, b), "value", mine, filled[b]))
            before += filled[b]
        q1, q3 = (found[math.floor(at)] * (1 - at % 1) + found[math.ceil(at)] * (at % 1) for at in places.values())
        fences = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        return Outliers(fences=fences), fences

    def _beyond(self, m: Measure, test: Outliers, bounds: tuple[float, float] | None, own: Moments, values: DataFrame, filled: dict[int, int], edges: list[float]) -> int:
        """How many values an outlier rule names: intervals on one side of a bound by their counts, others by their values."""
        if bounds is None:
            return 0
        slack = 1e-9 * (abs(bounds[0]) + abs(bounds[1]))
        whole, across = 0, []
        for b, n in filled.items():
            low, high = edges[b - 1] if b > 0 else own.least, edges[b] if b < len(edges) else own.most
            if high < bounds[0] - slack or low > bounds[1] + slack:
                whole += n
            elif not (low > bounds[0] + slack and high < bounds[1] - slack):
                across.append(b)
        if not across:
            return whole
        rows = reduce(DataFrame.unionAll, [self._span(values, m.column, edges, b) for b in across])
        return whole + rows.where(test.predicate(F.col("value"))).count()

    def _judge(self, wide: dict[str, object], outliers: dict[str, Outliers], scanned: int, states: DataFrame | None) -> Outcome:
        for m in self.measures:
            wide.setdefault(m.key, 0)
            if m.rule in ("distribution", "unique"):
                wide.setdefault(f"{m.key}_n", 0)
            if m.rule == "distribution":
                wide.update({k: wide.get(k, 0.0) for k in (f"{m.key}_m2", f"{m.key}_skew", f"{m.key}_kurt")})
        one = self.spark.range(1).select(*[F.lit(v).cast("double" if isinstance(v, float) else "bigint").alias(k) for k, v in wide.items()])
        status, detail, broken = verdict(self.rules, self.measures, missing_columns(self.rules, self.whole.schema, self.check))
        got = one.select(status.alias("status"), detail.alias("detail"), broken.alias("broken")).first()
        sample: list[str] = []
        if got["status"] == FAIL and states is not None:
            files = self._offending_files(states, got["broken"], outliers)
            if files:
                sample = list(sample_json(self._rows(files), self.rules, self.order_by, outliers, only=got["broken"]).first()["sample"])
        return Outcome(got["status"], got["detail"], sample, scanned)

    def _offending_files(self, states: DataFrame, broken: Sequence[int], outliers: dict[str, Outliers]) -> list[str]:
        """Files that hold rows which break one of the rules; only they are read for the sample."""
        tests = [F.col(m.key) > 0 for m in self.measures if m.ord in broken and _held(m) == "count"]
        found = [states.where(reduce(Column.__or__, tests)).select("file")] if tests else []
        for m in self.valued:
            if m.ord in broken and m.key in outliers:
                own = self._table("values").where((F.col("column") == m.column) & outliers[m.key].predicate(F.col("value")))
                found.append(own.select("file").join(states.select("file"), "file", "left_semi"))
        return sorted(r["file"] for r in reduce(DataFrame.unionAll, found).distinct().collect()) if found else []
