"""Exact percentiles of numeric columns without sorting or shuffling the data.

The wanted ranks are closed in on: a fixed-size sketch proposes an interval
around each rank, exact counts say on which side of (or inside) it the rank
lies, and the next pass looks only at the values strictly inside, until few are
left to be numbered. Ties at an interval bound resolve at once, so a value held
by a third of all rows cannot stall it. Sketches are merged in two levels, first
within groups of tasks, so no task receives one from every other. Each pass is a
scan with pushed-down bounds and a handful of numbers per column back; it
narrows the candidates some hundredfold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.lineage import discard, fresh_dir
from plumbline.functions.text import as_number, column

#: Size of a sketch, the share of the data its proposals leave on either side of a rank, and groups of the first merge.
SKETCH_SIZE, MARGIN, MERGE_GROUPS = 4096, 2e-3, 64
#: Candidates of an interval that are numbered instead of narrowed again.
FEW = 20_000


@dataclass
class _Search:
    """An open interval of one column and the wanted ranks that lie in it.

    ``ranks`` maps a rank in the whole column to the rank among the ``count``
    candidates of the interval; both count from zero.
    """

    column: str
    ranks: dict[int, int]
    count: int
    low: float | None = None
    high: float | None = None

    @property
    def candidate(self) -> Column:
        col = F.col(self.column)
        inside = col.isNotNull()
        if self.low is not None:
            inside = inside & (col > self.low)
        if self.high is not None:
            inside = inside & (col < self.high)
        return inside


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], at_least: int = 1, few: int = FEW
) -> dict[str, list[float | None]]:
    """Percentiles by linear interpolation at ``p * (n - 1)``, NULL and NaN left out.

    A column with fewer than ``at_least`` numbers gets ``None`` throughout.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = df.select(*[as_number(column(c), types[c]).alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]
    everything = [_Search(n, {0: 0}, 0) for n in names]
    around = [bound for p in probs for bound in _around(p, p)]
    first = _sketched(numbers, everything, [around] * len(names), [F.count(n).alias(f"n{i}") for i, n in enumerate(names)])
    found: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names}
    sizes = {n: first[f"n{i}"] for i, n in enumerate(names)}
    enough = [n for n in names if sizes[n] >= max(at_least, 1)]
    guesses = []
    for n in enough:
        bounds = first[f"q{names.index(n)}"]
        for i, p in enumerate(probs):
            at = p * (sizes[n] - 1)
            guesses.append((_Search(n, {r: r for r in {math.floor(at), math.ceil(at)}}, sizes[n]), *bounds[2 * i : 2 * i + 2]))
    values = _values_at(numbers, guesses, few)
    for n in enough:
        found[n] = [_interpolate(values, n, p * (sizes[n] - 1)) for p in probs]
    return {c: found[n] for c, n in zip(columns, names, strict=True)}


def _around(first: float, last: float) -> tuple[float, float]:
    """Shares of the data between which the sketch is asked to bracket some ranks."""
    return max(0.0, first - MARGIN), min(1.0, last + MARGIN)


def _sketched(numbers: DataFrame, searches: list[_Search], shares: list[list[float]], counts: Sequence[Column] = ()) -> Row:
    """One row: per search the sketch's values ``q<i>`` at the given shares of its candidates, NULL without candidates; any counts."""
    held = [F.when(s.candidate, F.col(s.column)) for s in searches]
    sketches = [F.kll_sketch_agg_double(h, F.lit(SKETCH_SIZE)).alias(f"s{i}") for i, h in enumerate(held)]
    some = [F.count(h).alias(f"m{i}") for i, h in enumerate(held)]
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g")
    parts = numbers.groupBy(group).agg(*sketches, *some, *counts)
    names = [c for c in parts.columns if c not in ("g", *[f"s{i}" for i in range(len(searches))])]
    merged = [
        F.kll_merge_agg_double(F.when(F.col(f"m{i}") > 0, F.col(f"s{i}")), F.lit(SKETCH_SIZE)).alias(f"s{i}") for i in range(len(searches))
    ]
    whole = parts.agg(*merged, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    asked = [
        F.when(F.col(f"m{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.array(*map(F.lit, shares[i])))).alias(f"q{i}")
        for i in range(len(searches))
    ]
    return whole.select(*asked, *names).first()


def _interpolate(values: dict[tuple[str, int], float], name: str, at: float) -> float:
    low, high = math.floor(at), math.ceil(at)
    share = at - low
    return values[name, low] * (1 - share) + values[name, high] * share


def _values_at(numbers: DataFrame, guesses: list[tuple[_Search, float, float]], few: int) -> dict[tuple[str, int], float]:
    """The value at each wanted rank."""
    found: dict[tuple[str, int], float] = {}
    while guesses:
        searches = _split(numbers, guesses, found)
        found.update(_count_through(numbers, [s for s in searches if s.count <= few]))
        guesses = _propose(numbers, [s for s in searches if s.count > few])
    return found


#: A column of this name says how often each row counts.
WEIGHT = "_weight"


def _weight(numbers: DataFrame) -> Column:
    return F.col(WEIGHT) if WEIGHT in numbers.columns else F.lit(1)


def _within(numbers: DataFrame, searches: list[_Search]) -> DataFrame:
    """Only rows some search still needs, so the bounds reach the scan."""
    return numbers.where(reduce(Column.__or__, [s.candidate for s in searches]))


def _propose(numbers: DataFrame, searches: list[_Search]) -> list[tuple[_Search, float, float]]:
    """The searches, each with a proposed inner interval."""
    if not searches:
        return []
    shares = []
    for s in searches:
        ranks = [rank / max(s.count - 1, 1) for rank in s.ranks.values()]
        shares.append(list(_around(min(ranks), max(ranks))))
    row = _sketched(_within(numbers, searches), searches, shares)
    return [(s, *row[f"q{i}"]) for i, s in enumerate(searches)]


def _split(
    numbers: DataFrame, guesses: list[tuple[_Search, float, float]], found: dict[tuple[str, int], float]
) -> list[_Search]:
    """Count exactly on both sides of the proposed bounds; record ranks that hit a bound."""
    parts = []
    for k, (s, low, high) in enumerate(guesses):
        col = F.col(s.column)
        at_high = col == high if high > low else F.lit(False)
        for part, test in (("a", col < low), ("b", col == low), ("c", (col > low) & (col < high)), ("d", at_high)):
            parts.append(F.coalesce(F.sum(F.when(s.candidate & test, _weight(numbers))), F.lit(0)).alias(f"{part}{k}"))
    tally = _within(numbers, [s for s, _, _ in guesses]).agg(*parts).first()
    return [
        piece
        for k, (s, low, high) in enumerate(guesses)
        for piece in _settle(s, low, high, [tally[f"{part}{k}"] for part in "abcd"], found)
    ]


def _settle(
    s: _Search, low: float, high: float, sizes: list[int], found: dict[tuple[str, int], float]
) -> list[_Search]:
    """Split the ranks by the part of the interval that exact counts put them in."""
    below, at_low, between, at_high = sizes
    starts = [0, below, below + at_low, below + at_low + between, sum(sizes), s.count]
    bounds = [(s.low, low), low, (low, high), high, (high, s.high)]
    out = []
    for bound, start, stop in zip(bounds, starts, starts[1:], strict=False):
        mine = {absolute: rank - start for absolute, rank in s.ranks.items() if start <= rank < stop}
        if isinstance(bound, tuple):
            if mine:
                out.append(_Search(s.column, mine, stop - start, *bound))
        else:
            found.update({(s.column, absolute): bound for absolute in mine})
    return out


def _count_through(numbers: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], float]:
    """Last step: few enough distinct values are left to number them in order."""
    if not searches:
        return {}
    hits = F.array(*[F.when(s.candidate, F.struct(F.lit(i).alias("i"), F.col(s.column).alias("v"), _weight(numbers).alias("n"))) for i, s in enumerate(searches)])
    held = _within(numbers, searches).select(F.inline(F.array_compact(hits)))
    counts = held.groupBy("i", "v").agg(F.sum("n").alias("n"))
    seen = counts.withColumn("seen", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
    wanted = [(i, s.column, absolute, rank) for i, s in enumerate(searches) for absolute, rank in s.ranks.items()]
    picks = [F.min(F.when((F.col("i") == i) & (F.col("seen") > rank), F.col("v"))) for i, _, _, rank in wanted]
    return {(name, absolute): value for (_, name, absolute, _), value in zip(wanted, seen.agg(*picks).first(), strict=True)}


def values_at_ranks(numbers: DataFrame, name: str, ranks: dict[int, int], count: int, few: int = FEW) -> dict[int, float]:
    """The values at some ranks of a column that holds ``count`` numbers; ``ranks`` maps the keys of the answer to them."""
    search = _Search(name, ranks, count)
    found = _count_through(numbers, [search]) if count <= few else _values_at(numbers, _propose(numbers, [search]), few)
    return {absolute: value for (_, absolute), value in found.items()}


#: Size of the sketch that rides along with a first pass, and the margin that outweighs its error.
FIRST_SKETCH, FIRST_MARGIN = 1024, 6e-3


@dataclass(frozen=True)
class Fenced:
    """What two scans tell: aggregates of the first, counts of the second, fences per column, and how many values lie beyond them."""

    first: dict[str, object]
    late: dict[str, int]
    fences: dict[str, tuple[float, float] | None]
    beyond: dict[str, int]


def _bounds(df: DataFrame, numbers: dict[str, Column], first: Sequence[Column]) -> tuple[Row, dict[str, int], dict[str, list[float]]]:
    """First scan: the caller's aggregates, sizes, and values around both quartiles of each column with enough numbers."""
    shares = [max(0.0, 0.25 - FIRST_MARGIN), 0.25 + FIRST_MARGIN, 0.75 - FIRST_MARGIN, min(1.0, 0.75 + FIRST_MARGIN)]
    counted = [F.count(v).alias(f"_n{i}") for i, v in enumerate(numbers.values())]
    sketched = [F.kll_sketch_agg_double(v, F.lit(FIRST_SKETCH)).alias(f"_s{i}") for i, v in enumerate(numbers.values())]
    asked = [F.when(F.col(f"_n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"_s{i}"), F.array(*map(F.lit, shares)))) for i in range(len(numbers))]
    row = df.agg(*first, *counted, *sketched).withColumns({f"_s{i}": a for i, a in enumerate(asked)}).first()
    sizes = {c: row[f"_n{i}"] for i, c in enumerate(numbers)}
    return row, sizes, {c: list(row[f"_s{i}"]) for i, c in enumerate(numbers) if sizes[c] >= 4}


def fences_in_two_scans(
    df: DataFrame, columns: Sequence[str], first: Sequence[Column] = (), late: Callable[[Row], dict[str, Column]] = lambda row: {}, few: int = FEW
) -> Fenced:
    """Interquartile fences of numeric columns and the values beyond them, exactly, whatever the size of the data.

    The first scan takes a sketch of each column beside the caller's ``first`` aggregates. The sketch says between which
    values a quartile lies, and so where the fences can be. The second scan counts rows by where their value lies, beside
    the caller's ``late`` conditions (made from the first scan's row), and by value only the some hundredth that is in
    doubt. Its result is a table in which the rest is decided. Columns with fewer than four numbers have no fences. Where a
    sketch missed a quartile, which its margin makes very unlikely, the column is searched anew.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = {c: as_number(column(c), types[c]) for c in columns}
    row, sizes, bounds = _bounds(df, numbers, first)
    known = {k: v for k, v in row.asDict().items() if not k.startswith(("_n", "_s"))}
    fences: dict[str, tuple[float, float] | None] = dict.fromkeys(columns)
    beyond, conditions = dict.fromkeys(columns, 0), late(row)
    if not bounds and not conditions:
        return Fenced(known, {}, fences, beyond)

    # a row's part in column i: which of the tests hold for its value, and the value itself if it is in doubt
    zones, tests, placed, parts = {}, {}, [], []
    for i, (c, (a1, b1, a3, b3)) in enumerate(bounds.items()):
        v = F.col(f"_x{i}")
        zones[c] = (a1 - 1.5 * (b3 - a1), b1 - 1.5 * (a3 - b1)), (a3 + 1.5 * (a3 - b1), b3 + 1.5 * (b3 - a1))
        (low, low_most), (high_least, high) = zones[c]
        zone = v.between(low, low_most) | v.between(high_least, high)
        tests[i] = {"below first": v < a1, "at first": v.between(a1, b1), "below third": v < a3, "at third": v.between(a3, b3), "out": (v < low) | (v > high), "zone": zone}
        mask = reduce(Column.__add__, [F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests[i].values())])
        doubt = F.when(v.between(a1, b1) | v.between(a3, b3) | zone, v)
        placed += [F.when(v.isNotNull(), mask).alias(f"_m{i}"), doubt.alias(f"_d{i}")]
        parts.append(F.struct(F.lit(i).alias("i"), F.col(f"_m{i}").alias("mask"), F.col(f"_d{i}").alias("v")))
    for j, condition in enumerate(conditions.values(), len(bounds)):
        placed.append(F.when(condition, 0).alias(f"_m{j}"))
        parts.append(F.struct(F.lit(j).alias("i"), F.col(f"_m{j}").alias("mask"), F.lit(None).cast("double").alias("v")))
    path = fresh_dir(df.sparkSession, "doubt")
    try:
        rows = df.select("*", *[numbers[c].alias(f"_x{i}") for i, c in enumerate(bounds)])
        rows = rows.select(*placed)
        each = (rows.select(F.inline(F.array(*parts))) if len(parts) > 1 else rows.select(parts[0].alias("e")).select("e.*")).where("mask IS NOT NULL")
        each.groupBy("i", "mask", "v").agg(F.count(F.lit(1)).alias(WEIGHT)).write.parquet(path)
        table = df.sparkSession.read.schema(f"i int, mask int, v double, {WEIGHT} long").parquet(path)
        met = table.groupBy("i", "mask").agg(F.sum(WEIGHT).alias("n")).collect()
        seen = {(i, name): sum(r["n"] for r in met if r["i"] == i and r["mask"] >> k & 1) for i in tests for k, name in enumerate(tests[i])}
        wanted, large, picks, values, missed = [], [], [], {}, set()
        for i, c in enumerate(bounds):
            a1, b1, a3, b3 = bounds[c]
            for p, name, low, high in ((0.25, "first", a1, b1), (0.75, "third", a3, b3)):
                start, size, at = seen[i, f"below {name}"], seen[i, f"at {name}"], p * (sizes[c] - 1)
                ranks = {r: r - start for r in (math.floor(at), math.ceil(at))}
                held = (F.col("i") == i) & F.col("v").between(low, high)
                if min(ranks.values()) < 0 or max(ranks.values()) >= size:
                    missed.add(c)
                elif size <= few:
                    wanted.append(((i, p), ranks))
                    picks.append(F.array_sort(F.collect_list(F.when(held, F.struct("v", WEIGHT)))).alias(f"p{len(wanted) - 1}"))
                else:
                    large.append(((i, p), ranks, size, held))
            if seen[i, "zone"] <= few:
                picks.append(F.collect_list(F.when((F.col("i") == i) & F.col("mask").bitwiseAND(1 << 5).cast("boolean"), F.struct("v", WEIGHT))).alias(f"z{i}"))
        got = table.agg(*picks).first().asDict() if picks else {}
        for j, (key, ranks) in enumerate(wanted):
            values[key] = _at_ranks(got[f"p{j}"], ranks)
        for key, ranks, size, held in large:
            values[key] = values_at_ranks(table.select(F.when(held, F.col("v")).alias("held"), WEIGHT), "held", ranks, size, few)
        for i, c in enumerate(bounds):
            if c in missed:
                fences[c] = iqr_fences(df, [c])[c]
            else:
                q1, q3 = (_interpolate({(c, r): x for r, x in values[i, p].items()}, c, p * (sizes[c] - 1)) for p in (0.25, 0.75))
                fences[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
            (low, low_most), (high_least, high) = zones[c]
            first_fence, last_fence = fences[c]
            if not (low <= first_fence <= low_most and high_least <= last_fence <= high):
                beyond[c] = df.agg(F.count_if((numbers[c] < first_fence) | (numbers[c] > last_fence))).first()[0]
                continue
            if f"z{i}" in got:
                within = sum(x[WEIGHT] for x in got[f"z{i}"] if x["v"] < first_fence or x["v"] > last_fence)
            else:
                outside = (F.col("v") < first_fence) | (F.col("v") > last_fence)
                within = table.where((F.col("i") == i) & F.col("mask").bitwiseAND(1 << 5).cast("boolean") & outside).agg(F.coalesce(F.sum(WEIGHT), F.lit(0))).first()[0]
            beyond[c] = within + seen[i, "out"]
    finally:
        discard(df.sparkSession, path)
    late_counts = {name: sum(r["n"] for r in met if r["i"] == len(bounds) + j) for j, name in enumerate(conditions)}
    return Fenced(known, late_counts, fences, beyond)


def _at_ranks(ordered: list[Row], ranks: dict[int, int]) -> dict[int, float]:
    """Values at ranks of weighted values in order."""
    out, before = {}, 0
    for value, weight in ordered:
        out.update({at: value for at, r in ranks.items() if before <= r < before + weight})
        before += weight
    return out


def iqr_fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float] | None]:
    """Outlier fences per column; ``None`` where fewer than four numbers exist."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if isinstance(types[c], T.NumericType)]
    out: dict[str, tuple[float, float] | None] = dict.fromkeys(columns)
    if not numeric:
        return out
    for name, (q1, q3) in exact_percentiles(df, numeric, [0.25, 0.75], at_least=4).items():
        if q1 is not None:
            out[name] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out
