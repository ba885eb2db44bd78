"""Checks across tables: orphans, missing counterparts, reconciliation.

No join carries a broadcast hint: Catalyst broadcasts a side only when its size
is known to be small. Children are folded to one row per key before they are
joined wherever rows themselves are not asked for, so a parent that owns a
third of all children costs one row per task. Where child rows are the answer,
rows with a NULL key skip the join, and adaptive skew handling splits other hot keys on
the child's side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import column


def _keys(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _parent_keys(parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parent.select(*[column(k).alias(f"_p{i}") for i, k in enumerate(keys)])


def orphans(child: DataFrame, parent: DataFrame, child_key: str | Sequence[str], parent_key: str | Sequence[str]) -> DataFrame:
    """Child rows without a parent; a NULL key has none.

    NULL keys would all hash to one partition, so those rows skip the join; the
    scan for them prunes every row group whose statistics count no NULLs.
    """
    keys = _keys(child_key)
    parents = _parent_keys(parent, _keys(parent_key))
    unset = reduce(Column.__or__, [column(k).isNull() for k in keys])
    keyed = child.where(~unset)
    on = [keyed[k] == parents[f"_p{i}"] for i, k in enumerate(keys)]
    return keyed.join(parents, on, "left_anti").unionByName(child.where(unset))


def orphan_count(child: DataFrame, parent: DataFrame, child_key: str | Sequence[str], parent_key: str | Sequence[str]) -> DataFrame:
    """How many child rows have no parent: children are counted per key first."""
    keys = _keys(child_key)
    folded = child.groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return orphans(folded, parent, keys, parent_key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def orphans_of_any(child: DataFrame, parents: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Child rows lacking at least one of several parents ``(parent, child_key, parent_key)``.

    One pass over the child: a left outer join per parent against its distinct
    keys marks what was found, and one filter keeps the rows that lack a mark.
    Adaptive execution can split hot keys on the child's side of such joins.
    Rows with a NULL key lack that parent for certain and skip the joins.
    """
    unset = reduce(Column.__or__, [column(child_key).isNull() for _, child_key, _ in parents])
    marked, marks = child.where(~unset), []
    for i, (parent, child_key, parent_key) in enumerate(parents):
        known = parent.select(column(parent_key).alias(f"_key{i}")).distinct()
        marked = marked.join(known, marked[child_key] == known[f"_key{i}"], "left")
        marks.append(F.col(f"_key{i}").isNull())
    lost = marked.where(reduce(Column.__or__, marks)).select(*map(column, child.columns))
    return lost.unionByName(child.where(unset))


def _skip_nulls(left: DataFrame, right: DataFrame, on: Column | Sequence[tuple[str, str]]) -> tuple[DataFrame, Column, Column | None]:
    """Rows whose keys are set, the condition, and the test for the others; key pairs only, conditions stay as they are."""
    if isinstance(on, Column):
        return left, on, None
    unset = reduce(Column.__or__, [left[a].isNull() for a, _ in on])
    return left.where(~unset), reduce(Column.__and__, [left[a] == right[b] for a, b in on]), unset


def without_match(left: DataFrame, right: DataFrame, on: Column | Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` for which no row of ``right`` meets the condition.

    Given as pairs of column names, rows with a NULL key skip the join.
    """
    keyed, test, unset = _skip_nulls(left, right, on)
    out = keyed.join(right, test, "left_anti")
    return out if unset is None else out.unionByName(left.where(unset))


def with_match(left: DataFrame, right: DataFrame, on: Column | Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` for which some row of ``right`` meets the condition, once each."""
    keyed, test, _ = _skip_nulls(left, right, on)
    return keyed.join(right, test, "left_semi")


def joined_count(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Row count of an inner join, from key counts of both sides."""
    a = left.groupBy(column(left_key).alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(column(right_key).alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n"))


def over_limit(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, limit: Column) -> DataFrame:
    """Parents that own more children than a limit on the parent row allows."""
    owned = child.groupBy(column(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return parent.join(owned, parent[parent_key] == owned["_k"]).where(F.col("n") > limit).drop("_k")


def reconcile(
    parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, stated: Column, amount: Column, tolerance: float = 0.0
) -> DataFrame:
    """Parents whose stated total differs from the sum over their children.

    A parent without children reconciles against zero.
    """
    sums = child.groupBy(column(child_key).alias("_k")).agg(F.sum(amount).alias("_sum"))
    joined = parent.join(sums, parent[parent_key] == sums["_k"], "left")
    compared = joined.select(
        column(parent_key), stated.alias("stated"), F.coalesce(F.col("_sum"), F.lit(0)).alias("actual")
    )
    return compared.where(F.abs(F.col("stated") - F.col("actual")) > tolerance)


def total_mismatch(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, stated: Column, amount: Column, tolerance: float = 0.0) -> DataFrame:
    """Like :func:`reconcile`, but a parent without children has no total to break."""
    sums = child.groupBy(column(child_key).alias("_k")).agg(F.sum(amount).alias("actual"))
    joined = parent.join(sums, parent[parent_key] == sums["_k"]).select(column(parent_key), stated.alias("stated"), "actual")
    return joined.where(F.abs(F.col("stated") - F.col("actual")) > tolerance)


def side_by_side(first: DataFrame, **others: DataFrame) -> DataFrame:
    """One-row results as columns of one row, each read as a scalar subquery."""
    return first.select("*", *[df.scalar().alias(name) for name, df in others.items()])
