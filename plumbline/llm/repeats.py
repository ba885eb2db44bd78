"""Long repeats across a corpus: a run-length index over the places where texts can match.

Every string of ``length`` bytes has a smallest window hash (its minimizer), so equal strings meet under one key. Consecutive
strings with one key travel together as a segment; equal segments are one variant with a weight. Variants of a key go into
an index: the suffixes of a bounded set of variants, their Burrows-Wheeler transform in runs, and matching lengths sampled
where runs begin. All other lengths follow from those, one less per byte, and are streamed over the variants; a string that
matches another over its whole length is a repeat.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import keep, map_batches, ship

LENGTH, GRAM = 400, 64
#: Bytes of variants in one index, about; with suffixes and ranks an index takes some 60 times as much memory.
INDEX_BYTES = 1_500_000
#: Keys with more variants than this are settled by counting their strings, one by one (see ``_counted``).
MANY = 1000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each ``gram`` bytes."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_letters()[data] * up[:n], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` hashes in a row."""
    span = 1
    while 2 * span <= width:
        hashes = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    return np.minimum(hashes[: len(hashes) - (width - span)], hashes[width - span :]) if width > span else hashes


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of strings and keys of a text's segments: runs of strings with one key, cut at ``length`` strings.

    Last, whether the segment holds its smallest window twice; without that no two of its strings can be equal.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    hashes, width = gram_hashes(np.frombuffer(data, dtype=np.uint8), gram), length - gram + 1
    keys = minimizers(hashes, width)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(starts, len(keys)))
    if counts.max() > length:
        pieces = -(-counts // length)
        which = np.repeat(np.arange(len(starts)), pieces)
        within = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        counts = np.minimum(length, counts[which] - within * length)
        starts = starts[which] + within * length
    own = keys[starts]
    known = np.unique(own)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    places = np.flatnonzero(known[at] == hashes)
    size = len(hashes) + 1
    marks = np.sort(at[places] * size + places)
    base = np.searchsorted(known, own) * size
    held = np.searchsorted(marks, base + np.minimum(starts + counts - 1 + width, size - 1)) - np.searchsorted(marks, base + starts)
    return starts, counts, own, held > 1


def suffix_array(codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Order of all suffixes. ``codes``: bytes plus one; ``rest``: bytes from each place to the end of its text, itself included.

    Suffixes end with their text; equal ones stay in order of place. Ranks by seven bytes are doubled until all differ or
    the longest text is covered.
    """
    n = len(codes)
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(7, dtype=np.int64)])
    for k in range(7):
        key = (key << 9) | np.where(rest > k, padded[k : k + n], 0)
    covered, most = 7, int(rest.max())
    while True:
        order = np.argsort(key, kind="stable")
        turns = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], turns[1:] != turns[:-1]]))
        if covered >= most or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[: n - covered] = np.where(rest[: n - covered] > covered, rank[covered:] + 1, 0) if covered < n else 0
        key = rank * (n + 1) + after
        covered *= 2


def common(packed: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at places a and b, within their texts."""
    most = np.minimum(rest[a], rest[b])
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        differ = packed[x] ^ packed[y]
        same = differ == 0
        low = differ[~same]
        out[live[~same]] += np.bitwise_count((low & -low) - np.uint64(1)).astype(np.int64) >> 3
        out[live[same]] += 8
        live = live[same]
        live = live[out[live] < most[live]]
    return np.minimum(out, most)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of several texts, with matching lengths sampled at the runs' beginnings."""

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts])
        self.starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(data)
        self.rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
        self.order = suffix_array(data.astype(np.int32) + 1, self.rest)
        before = np.where(np.isin(np.arange(n), self.starts), -1 - np.arange(n), np.concatenate([[0], data[:-1].astype(np.int64)]))
        last = before[self.order]  # the transform; texts' beginnings count as letters of their own
        self.run_starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        wide = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
        packed = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            packed |= wide[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        self.packed = np.append(packed, np.uint64(0))
        at = self.run_starts[self.run_starts > 0]
        self.sample_places = np.concatenate([self.order[:1], self.order[at]])
        self.samples = np.concatenate([[0], common(self.packed, self.rest, self.order[at], self.order[at - 1])])

    def lengths(self) -> np.ndarray:
        """For each suffix in order, how many bytes it shares with the one before it.

        Within a run the suffixes one byte earlier stand next to each other too, so their common length is one more: from
        each sample on, lengths fall by one per byte.
        """
        n = len(self.rest)
        sampled = np.full(n, -1, dtype=np.int64)
        sampled[self.sample_places] = np.arange(len(self.sample_places))
        where = np.where(sampled >= 0, np.arange(n), 0)
        np.maximum.accumulate(where, out=where)
        by_place = self.samples[sampled[where]] - (np.arange(n) - where)
        return np.maximum(by_place, 0)[self.order]

    def matched(self, owned: np.ndarray, length: int) -> np.ndarray:
        """Which of the ``owned`` places begin a string of ``length`` bytes that another owned place begins too."""
        mine = np.flatnonzero(owned[self.order])
        out = np.zeros(len(owned), dtype=bool)
        if len(mine) > 1:
            shared = np.minimum.reduceat(self.lengths()[: mine[-1] + 1], mine[:-1] + 1)
            long_ = shared >= length
            out[self.order[mine[:-1][long_]]] = True
            out[self.order[mine[1:][long_]]] = True
        return out


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _identity(id_col: str, text_col: str):
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("id"), F.xxhash64(text, F.lit(7)).alias("print"), text.alias("text")]


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _cut(docs: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """All segments of all texts."""

    def run(batches):
        for batch in batches:
            row, starts, counts, keys, prints, twice = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                a, n, key, again = segments(data, length, gram)
                row.append(np.full(len(a), k))
                starts.append(a)
                counts.append(n)
                keys.append(key)
                twice.append(again)
                prints += [xxhash.xxh3_64_intdigest(data[x : x + m + length - 1]) for x, m in zip(a.tolist(), n.tolist(), strict=True)]
            take = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
            join = lambda parts, dtype: np.concatenate(parts).astype(dtype) if parts else np.zeros(0, dtype)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("print").take(take), pa.array(join(starts, np.int32)), pa.array(join(counts, np.int32)),
                 pa.array(join(keys, np.uint64).view(np.int64)), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(join(twice, bool))],
                names=["id", "print", "start", "n", "key", "seg", "twice"],
            )

    return map_batches(docs, run, f"id {kind}, print long, start int, n int, key long, seg long, twice boolean")


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Key, segment, number of strings, weight, place in an index and bytes of the wanted variants, from one text each."""
    lists = wanted.groupBy("rep.id", "rep.print").agg(F.collect_list(F.struct("rep.start", "n", "key", "seg", "weight", "many")).alias("wanted"))
    texts = docs.alias("d").join(lists.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.print") == F.col("w.print"))).select("text", "wanted")

    def run(batches):
        for batch in batches:
            out = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(w["key"], w["seg"], w["n"], w["weight"], w["many"], data[w["start"] : w["start"] + w["n"] + length - 1]) for w in own]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "seg", "n", "weight", "many", "data"])

    # a repeated row has the same identity twice; one copy of a variant is enough
    return map_batches(texts, run, "key long, seg long, n int, weight long, many boolean, data binary").dropDuplicates(["key", "seg"])


def _indexed(variants: DataFrame, buckets: int, length: int) -> DataFrame:
    """Key, segment and ranges of repeated strings, from run-length indexes over buckets of keys."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "seg"]).reset_index(drop=True)
        texts, counts = frame["data"].tolist(), frame["n"].to_numpy()
        sizes = np.array([len(t) for t in texts])
        # more than one index where a bucket has become large; a key's variants are never parted
        turns = np.flatnonzero(np.concatenate([[True], np.diff(frame["key"].to_numpy()) != 0, [True]]))
        done, first, out = np.append(0, np.cumsum(sizes)), 0, [None] * len(texts)
        for k in range(1, len(turns)):
            if k < len(turns) - 1 and done[turns[k + 1]] - done[turns[first]] <= 2 * INDEX_BYTES:
                continue
            a, b = turns[first], turns[k]
            index = RunIndex(texts[a:b])
            within = np.arange(len(index.rest)) - np.repeat(index.starts, sizes[a:b])
            owned = within < np.repeat(counts[a:b], sizes[a:b])
            found = index.matched(owned, length)
            for v in range(a, b):
                at = index.starts[v - a]
                out[v] = ranges(found[at : at + counts[v]])
            first = k
        out = [[(0, int(n))] if w > 1 else r for r, n, w in zip(out, counts, frame["weight"], strict=True)]
        return pd.DataFrame({"key": frame["key"], "seg": frame["seg"], "found": [[{"a": a, "b": b} for a, b in r] for r in out]})

    ship(variants)
    return variants.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(run, "key long, seg long, found array<struct<a:int,b:int>>")


def _counted(variants: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many variants: their strings are counted by a 128-bit digest, combined before the shuffle."""

    def run(batches):
        for batch in batches:
            for key, seg, n, weight, data in zip(*(batch.column(c).to_pylist() for c in ("key", "seg", "n", "weight", "data")), strict=True):
                digests = [xxhash.xxh3_128_digest(data[k : k + length]) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.int64()), pa.array([seg] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([weight] * n, pa.int64()), pa.array(digests, pa.binary())],
                    names=["key", "seg", "at", "weight", "digest"],
                )

    each = keep(map_batches(variants.select("key", "seg", "n", "weight", "data"), run, "key long, seg long, at int, weight long, digest binary"), "strings")
    again = each.groupBy("digest").agg(F.sum("weight").alias("total")).where("total > 1").select("digest")
    return each.join(again, "digest").groupBy("key", "seg").agg(F.transform(F.collect_list("at"), lambda x: F.struct(x.alias("a"), (x + 1).alias("b"))).alias("found"))


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``text``, and ``spans``, the maximal byte ranges covered by strings of ``length`` bytes that begin elsewhere too.

    Texts are UTF-8 bytes, null counts as empty, matches stay within a text, and another place in the same text counts.
    Repeated rows repeat each other's text. An empty table gives an empty result; other columns are ignored. Indexes hold
    about ``INDEX_BYTES``; a key has at most ``many`` variants in one, and beyond that its strings are counted instead, which
    is exact as well, so a passage found in a third of all texts does not end in one task.
    """
    own = docs.select(*_identity(id_col, text_col))
    kind = own.schema["id"].dataType.simpleString()
    segs = keep(_cut(own, kind, length, gram), "segments")
    variants = segs.groupBy("key", "seg").agg(F.count("*").alias("weight"), F.min(F.struct("id", "print", "start")).alias("rep"), F.max("n").alias("n"))
    sizes = segs.groupBy("key").agg(F.count("*").alias("total"), F.min("seg").alias("low"), F.max("seg").alias("high"), F.max("twice").alias("twice")).where("total > 1 or twice")
    variants = keep(variants.join(sizes, "key").select("key", "seg", "weight", "rep", "n", ((F.col("low") == F.col("high")) & (F.col("total") > 1)).alias("alone")), "variants")
    crowd = variants.where("not alone").groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > many).withColumn("many", F.lit(True)).select("key", "many")
    wanted = variants.where("not alone").join(crowd, "key", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    fetched = keep(_fetch(own, wanted, length), "variant-texts")
    size = fetched.where("not many").agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    whole = variants.where("alone").select("key", "seg", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("found"))
    marks = whole.unionAll(_indexed(fetched.where("not many"), max(1, -(-size // INDEX_BYTES)), length)).unionAll(_counted(fetched.where("many"), length))
    marks = keep(marks.where(F.size("found") > 0), "marks")
    hits = segs.join(marks, ["key", "seg"]).select("id", "print", F.transform("found", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + length - 1).alias("b"))).alias("r"))
    by_text = hits.groupBy("id", "print").agg(F.flatten(F.collect_set("r")).alias("r"))
    joined = own.alias("d").join(by_text.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.print") == F.col("m.print")), "left").select(F.col("d.id").alias("id"), "text", "r")

    def merge(batches):
        for batch in batches:
            out = []
            for own in batch.column("r").to_pylist():
                spans: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in own or []):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                out.append([{"a": a, "b": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(out, _RANGES)], names=[id_col, "text", "spans"])

    return map_batches(joined, merge, f"{id_col} {kind}, text string, spans array<struct<a:int,b:int>>")


def remove_repeats(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From :func:`find_repeats`: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of the bytes that stay, and these as text.

    ``kept_text`` has a replacement mark where a removed range ends inside a character.
    """

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
                for s in spans:
                    parts.append(data[at : s["a"]])
                    at = s["b"]
                left = b"".join([*parts, data[at:]])
                n_bytes.append(len(data))
                n_removed.append(sum(s["b"] - s["a"] for s in spans))
                n_spans.append(len(spans))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return map_batches(found, run, f"{id_col} {found.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
