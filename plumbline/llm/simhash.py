"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are routed by their parts: of three parts, two fingerprints that differ in at most two bits share one
whole. The fingerprints that share a part are sorted by Gray rank, so that those with common leading bit patterns stand
together; each level of the index factors a longer masked pattern into one node, and pairs of nodes whose differences so
far exceed the limit are pruned with everything below them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.components import components
from plumbline.llm.store import keep, map_batches, ship, unused

SEED, SHINGLE, BITS = 42, 3, 64


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=">u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[a : a + 65_536].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """Id, other columns and ``fp``, the 64-bit fingerprint as a signed long, per row; null texts count as empty."""
    kept = [id_col, *others]

    def run(batches):
        for batch in batches:
            own = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(own.view(np.int64))], names=[*kept, "fp"])

    rows = docs.select(*kept, F.col(text_col).alias("text"))
    return map_batches(rows, run, StructType([rows.schema[c] for c in kept]).add("fp", "long"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in Gray order."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def index_pairs(codes: np.ndarray, groups: np.ndarray, limit: int, step: int = 8, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of codes of one group that differ in at most ``limit`` bits.

    Top nodes of the index are the groups (codes that share one masked part). Each further level holds the distinct leading
    patterns of ``step`` more bits; pairs of nodes descend with the differences they have gathered. Pairs beyond ``most`` go
    down a part at a time, so memory stays bounded.
    """
    order = np.lexsort((gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    turn = np.concatenate([[True], groups[1:] != groups[:-1]])[: len(codes)]
    levels, patterns = [np.flatnonzero(turn)], [np.zeros(int(turn.sum()), dtype=np.uint64)]
    for depth in range(step, BITS + 1, step):
        lead = codes >> np.uint64(BITS - depth)
        levels.append(np.flatnonzero(turn | np.concatenate([[True], lead[1:] != lead[:-1]])[: len(codes)]))
        patterns.append(lead[levels[-1]] & np.uint64((1 << step) - 1))
    levels.append(np.arange(len(codes)))
    none = np.empty(0, dtype=np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]

    def children(depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, below = levels[depth], levels[depth + 1]
        return np.searchsorted(below, own[nodes]), np.searchsorted(below, np.append(own[1:], len(codes))[nodes])

    def down(depth: int, left: np.ndarray, right: np.ndarray, gone: np.ndarray) -> None:
        """Pairs of nodes (left <= right) of a level, with the differences of their patterns."""
        if depth == len(levels) - 1:
            fine = left != right
            out.append((left[fine], right[fine]))
            return
        (la, lb), (ra, rb) = children(depth, left), children(depth, right)
        sizes = (lb - la) * (rb - ra)
        total = np.cumsum(sizes)
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
            n = sizes[a:b]
            which = np.repeat(np.arange(a, b), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (rb - ra)[which]
            x, y = la[which] + within // wide, ra[which] + within % wide
            more = gone[which]
            if depth + 1 < len(patterns):
                more = more + np.bitwise_count(patterns[depth + 1][x] ^ patterns[depth + 1][y])
            fine = ((left[which] != right[which]) | (x <= y)) & (more <= limit)
            down(depth + 1, x[fine], y[fine], more[fine])
            a = b

    big = np.flatnonzero(np.diff(np.append(levels[0], len(codes))) > 1)
    down(0, big, big, np.zeros(len(big), dtype=np.int64))
    return order[np.concatenate([x for x, _ in out])], order[np.concatenate([y for _, y in out])]


def local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest position that each of ``n`` positions is linked to, over the pairs at hand."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        differ = a != b
        if not differ.any():
            return root
        x, y, low = x[differ], y[differ], np.minimum(a[differ], b[differ])
        np.minimum.at(root, a[differ], low)
        np.minimum.at(root, b[differ], low)
        while (root[root] != root).any():
            root = root[root]


def links(distinct: DataFrame, limit: int = 2, bucket_rows: int = 50_000) -> DataFrame:
    """Pairs (``a``, ``b``) that join the distinct fingerprints in column ``fp`` exactly as all pairs within ``limit`` bits do.

    A fingerprint is sent once per part to the bucket of that part's value; each bucket's pairs come from its index, and
    what leaves the bucket is one row per linked fingerprint. A fingerprint has at most C(64,1) + C(64,2) partners, so even
    within a bucket pairs don't grow with the square of a group. ``distinct`` is a table, as it is read twice.
    """
    parts = limit + 1
    width = -(-BITS // parts)
    masks = [((1 << BITS) - 1) & (((1 << width) - 1) << BITS >> width * (k + 1)) for k in range(parts)]
    masks[-1] = ((1 << BITS) - 1) & ~sum(masks[:-1])
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    buckets = max(1, -(-distinct.count() * parts // bucket_rows))
    sent = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])).alias("p"))
    dealt = sent.select("fp", "p.*", F.pmod(F.xxhash64("p.part", "p.key"), F.lit(buckets)).alias("bucket"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.ascontiguousarray(frame["fp"].to_numpy(dtype=np.int64))
        _, groups = np.unique(frame[["part", "key"]].to_numpy(dtype=np.int64), axis=0, return_inverse=True)
        x, y = index_pairs(own.view(np.uint64), groups.ravel(), limit)
        root = local_roots(len(own), x, y)
        linked = np.flatnonzero(root != np.arange(len(own)))
        return pd.DataFrame({"a": own[linked], "b": own[root[linked]]})

    ship(distinct)
    return dealt.groupBy("bucket").applyInPandas(one, "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fp`` and ``component_id``, the smallest id whose fingerprint is reached over links of at most ``limit`` bits.

    Rows with one fingerprint are one node, so copies are never paired. Null and empty texts have fingerprint 0 and are
    linked like any other. Null ids never name a component unless all its ids are null. Repeated rows give repeated rows,
    an empty table an empty result; other columns are ignored.
    """
    prints = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    member = rooted(prints.groupBy("fp").agg(F.min(id_col).alias("least")), limit)
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def rooted(nodes: DataFrame, limit: int) -> DataFrame:
    """``nodes``, one row per fingerprint, with ``root``, the smallest fingerprint reached; it alone tells components apart."""
    nodes = keep(nodes, "distinct-fingerprints")
    roots = components(links(nodes.select("fp"), limit))
    return nodes.join(roots, nodes.fp == roots.node, "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, limit: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of :func:`near_duplicates`, with all its columns.

    It is the one with the smallest id, or with none if all ids are null; the fingerprint and then the text's digest settle
    ties, and exact repeats of that row are folded. An id that stands at texts of several components may stay once in each.
    """
    digest, id_, print_ = F.unhex(F.sha2(F.col(text_col), 256)), unused("chosen_id", docs.columns), unused("chosen_digest", docs.columns)
    pair = ["own_id", "own_digest"]
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), digest.alias("own_digest"))
    prints = keep(fingerprints(own, "own_id", "text", "own_digest"), "fingerprints")
    first = F.struct(F.col("own_id").isNull().alias("last"), "own_id", "fp", "own_digest")
    member = rooted(prints.groupBy("fp").agg(F.min(first).alias("least")), limit)
    best = member.groupBy("root").agg(F.min("least").alias("least")).select("least.own_id", "least.own_digest")
    sizes = prints.groupBy(pair).agg(F.count("*").alias("n"))
    same = F.col("a.own_id").eqNullSafe(F.col("b.own_id")) & F.col("a.own_digest").eqNullSafe(F.col("b.own_digest"))
    best = keep(best.alias("a").join(sizes.alias("b"), same).select("a.own_id", "a.own_digest", "n"), "survivors")

    def rows(chosen: DataFrame) -> DataFrame:
        chosen = chosen.select(F.col("own_id").alias(id_), F.col("own_digest").alias(print_))
        return docs.join(chosen, F.col(id_col).eqNullSafe(F.col(id_)) & digest.eqNullSafe(F.col(print_)), "left_semi")

    repeated = best.where("n > 1")
    if repeated.isEmpty():
        return rows(best)
    return rows(best.where("n = 1")).unionByName(rows(repeated).dropDuplicates([id_col, text_col]))
