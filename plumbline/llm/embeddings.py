"""Near-duplicate embeddings through spherical-cap filters from structured random product codes.

A filter is a direction put together from one random code word per block of coordinates, and a vector belongs to every
filter whose direction it leans towards by more than a threshold. All such filters are found by list decoding: the blocks'
scores are sorted and combined from the top, so directions out of reach are never looked at. Vectors close to each other
share filters; pairs are verified inside filters, in blocks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.components import components
from plumbline.llm.simhash import local_roots
from plumbline.llm.store import keep, map_batches, ship

#: Code words per block, and the threshold in standard deviations of a random vector's lean towards a direction.
WORDS, LEAN, SEED = 64, 2.6, 20240611
#: Filters that every vector has at least: where fewer exceed the threshold, the directions it leans towards most.
FEWEST = 24
#: Vectors of one filter that are compared at once.
CHUNK = 1024
#: Rows that one group for Python holds, about.
BUCKET = 4096


@lru_cache(maxsize=8)
def code(dim: int, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """Unit code words of each block of coordinates: two blocks, or one where there is one coordinate."""
    rng = np.random.default_rng([SEED, dim, words])
    out = []
    for part in np.array_split(np.arange(dim), min(2, dim)):
        own = rng.standard_normal((words, len(part)))
        out.append(own / np.linalg.norm(own, axis=1, keepdims=True))
    return tuple(out)


def decode(unit: np.ndarray, words: int = WORDS, lean: float = LEAN) -> list[np.ndarray]:
    """Filters of each unit vector, ascending: all directions it leans towards enough, and at least the ``FEWEST`` best."""
    dim = unit.shape[1]
    blocks, cuts = code(dim, words), np.cumsum([0, *[b.shape[1] for b in code(dim, words)]])
    scores = [unit[:, a:b] @ own.T for own, a, b in zip(blocks, cuts, cuts[1:], strict=False)]
    least = lean / np.sqrt(dim) * np.sqrt(len(blocks))
    out = []
    if len(blocks) == 1:
        return [np.flatnonzero(s >= min(least, np.sort(s)[-min(FEWEST, words)])) for s in scores[0]]
    orders = [np.argsort(-s, axis=1) for s in scores]
    tops = [np.take_along_axis(s, o, axis=1) for s, o in zip(scores, orders, strict=True)]
    # the best sums are among those of high places in both lists
    i, j = np.nonzero(np.outer(np.arange(1, words + 1), np.arange(1, words + 1)) <= FEWEST)
    floors = np.partition(tops[0][:, i] + tops[1][:, j], -FEWEST, axis=1)[:, -FEWEST]
    for k in range(len(unit)):
        first, second = tops[0][k], tops[1][k]
        need = min(least, floors[k])
        # how far down the second list each word of the first may go
        reach = np.searchsorted(-second, -(need - first) + 1e-12, side="right")
        rows = np.flatnonzero(reach)
        i = np.repeat(rows, reach[rows])
        j = np.arange(len(i)) - np.repeat(np.cumsum(reach[rows]) - reach[rows], reach[rows])
        out.append(np.sort(orders[0][k][i] * words + orders[1][k][j]))
    return out


def digest_of(v: list | None) -> bytes | None:
    """Digest of a usable vector; None for one that is null, empty, zero or holds null or non-finite components."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    own = np.asarray(v, dtype=np.float64) + 0.0
    return hashlib.sha256(own.tobytes()).digest() if np.isfinite(own).all() and own.any() else None


def unit(v: np.ndarray) -> np.ndarray:
    """The vector with length one, in double precision."""
    own = np.asarray(v, dtype=np.float64)
    own = own / np.abs(own).max()
    return own / np.linalg.norm(own)


def _filters(rows: DataFrame, words: int, lean: float) -> DataFrame:
    """Nodes with the filters they belong to."""

    def run(batches):
        for batch in batches:
            units = [unit(u) for u in batch.column("vec").to_pylist()]
            out: list = [None] * len(units)
            by: dict[int, list[int]] = {}
            for k, u in enumerate(units):
                by.setdefault(len(u), []).append(k)
            for own in by.values():
                for a in range(0, len(own), 4096):
                    part = own[a : a + 4096]
                    for k, found in zip(part, decode(np.stack([units[k] for k in part]), words, lean), strict=True):
                        out[k] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int16()))], names=[*batch.schema.names, "filters"])

    vec = rows.schema["vec"].dataType.simpleString()
    return map_batches(rows, run, f"node long, weight long, place string, vec {vec}, filters array<smallint>")


def _close(units: np.ndarray, first: np.ndarray, second: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``first`` and ``second`` of all pairs of rows with a cosine of at least ``least``."""
    a, b = np.stack(units[first]), np.stack(units[second])
    found = [np.nonzero(a[k : k + 512] @ b.T >= least) for k in range(0, len(a), 512)]
    return np.concatenate([x + 512 * k for k, (x, _) in enumerate(found)]), np.concatenate([y for _, y in found])


def _shared_before(filters: np.ndarray, x: np.ndarray, y: np.ndarray, here: int) -> np.ndarray:
    """Does each pair of rows share a filter with a smaller number than ``here``?"""
    own, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    lists = [np.asarray(filters[k], dtype=np.int64) for k in own]
    row = np.repeat(np.arange(len(own)), [len(f) for f in lists])
    col = np.concatenate(lists)
    row, col = row[col < here], col[col < here]
    bits = np.zeros((len(own), here // 8 + 1), dtype=np.uint8)
    np.bitwise_or.at(bits, (row, col >> 3), (1 << (col & 7)).astype(np.uint8))
    out = np.zeros(len(x), dtype=bool)
    for k in range(0, len(x), 50_000):
        out[k : k + 50_000] = (bits[at[: len(x)][k : k + 50_000]] & bits[at[len(x) :][k : k + 50_000]]).any(axis=1)
    return out


def near_vectors(vectors: DataFrame, least: float = 0.93, words: int = WORDS, lean: float = LEAN, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """Per row: id, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable, itself included), ``kept``.

    Rows link where labels are equal and not null and the cosine is at least ``least``; without ``label_col`` all rows are
    compared. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors are one node and are counted, not paired. A filter with more than ``chunk`` nodes is
    dealt into chunks and pairs of chunks, each its own group; pairs are counted where they are compared and never leave the
    task. A pair in several filters counts in the first they share. Links can be missed where two vectors share no filter
    (for cosines of 0.93 in 64 dimensions fewer than one in a hundred). Repeated rows are rows of their own, an empty table
    gives an empty result, other columns are ignored.
    """

    def clean(batches):
        for batch in batches:
            digests = [digest_of(v) for v in batch.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("place"), pa.array(digests, pa.binary()), batch.column("vec")], names=["id", "place", "digest", "vec"])

    if not 1 <= words <= 181:
        raise ValueError("words must lie between 1 and 181: filters are numbered in 16 bits")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    # vectors travel as they are stored, single precision as four bytes; cosines are taken in double precision
    own = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "double"
    source = vectors.select(F.col(id_col).alias("id"), F.concat_ws(":", F.size(vector_col).cast("string"), label).alias("place"), F.when(label.isNotNull(), F.col(vector_col).cast(f"array<{own}>")).alias("vec"))
    kind = source.schema["id"].dataType.simpleString()
    rows = keep(map_batches(source, clean, f"id {kind}, place string, digest binary, vec array<{own}>"), "vectors")
    usable = rows.where("digest is not null")
    nodes = keep(
        usable.groupBy("place", "digest").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()), "nodes",
    )
    spread = keep(_filters(nodes.select("node", "weight", "place", "vec"), words, lean), "filters")
    each = spread.select("node", "weight", "place", "vec", "filters", F.explode("filters").alias("filter"))
    sizes = spread.select("place", F.explode("filters").alias("filter")).groupBy("place", "filter").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = (
        each.join(sizes, ["place", "filter"]).withColumn("chunks", chunks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("node", "weight", "vec", "filters", "place", "filter", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    # many small groups go to Python together, in buckets whose number follows the rows
    rows_sent = dealt.count()
    bucket = F.pmod(F.xxhash64("place", "filter", "i", "j"), F.lit(max(1, -(-rows_sent // BUCKET))))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["place", "filter", "i", "j"], kind="stable")
        marks = frame[["filter", "i", "j"]].to_numpy(dtype=np.int64)
        place = frame["place"].to_numpy()
        turns = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(axis=1) | (place[1:] != place[:-1]), [True]]))
        units, filters = np.empty(len(frame), dtype=object), frame["filters"].to_numpy()
        units[:] = [unit(v) for v in frame["vec"]]
        mine, names, weights = frame["mine"].to_numpy(), frame["node"].to_numpy(dtype=np.int64), frame["weight"].to_numpy(dtype=np.int64)
        out = []
        for a, b in zip(turns, turns[1:], strict=False):
            here, i, j = marks[a]
            first, second = a + np.flatnonzero(mine[a:b] == i), a + np.flatnonzero(mine[a:b] == j)
            if not len(first) or not len(second):
                continue
            x, y = _close(units, first, second, least)
            if i == j:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            x, y = first[x], second[y]
            fresh = ~_shared_before(filters, x, y, int(here))
            own, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            at_x, at_y = at[: len(x)], at[len(x) :]
            n = np.bincount(at_x[fresh], weights=weights[y[fresh]], minlength=len(own)) + np.bincount(at_y[fresh], weights=weights[x[fresh]], minlength=len(own))
            out.append(pd.DataFrame({"node": names[own], "root": names[own[local_roots(len(own), at_x, at_y)]], "n": n.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "root": [], "n": []}).astype("int64")

    ship(vectors)
    found = keep(dealt.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(compare, "node long, root long, n long"), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found, "node", "root").withColumnRenamed("node", "of")
    member = nodes.select("node", "place", "digest", "least", "weight").join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of")
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "root").join(counts, "node", "left").select("place", "digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    joined = rows.select("id", "place", "digest").join(named, ["place", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
