"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the shingles themselves.

A short item inside a long document has next to no Jaccard similarity with it, so signatures of whole documents would say
nothing. Here only the items carry MinHash signatures: the shingles with the smallest hashes, as many as an item of its
size partition needs so that no text holding enough of it can miss all of them. Documents are read once, shingle by shingle,
against the signatures; a document that meets one is compared with all of the item's shingles.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.store import map_batches, slices

WIDTH, SHARE = 5, 0.8
#: Bytes of items in one block; each block is one pass over the documents.
BLOCK_BYTES = 32 << 20
MEMO = 600_000
_WORD = re.compile(r"[^\W_]+")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
#: In place of a word's hash: no word, more than one.
NONE, MANY = 0, 1


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Hasher:
    """Hashes of the words of lower-cased texts; a chunk between blanks is looked at once while it is remembered."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def _one(self, chunk: str) -> int:
        found = _WORD.findall(chunk)
        return NONE if not found else MANY if len(found) > 1 else max(2, xxhash.xxh64_intdigest(found[0]))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        chunks = [t.lower().split() for t in texts]
        new = set().union(*chunks).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, set().union(*chunks)
        self.memo.update((c, self._one(c)) for c in new)
        get, out = self.memo.__getitem__, []
        for text, own in zip(texts, chunks, strict=True):
            found = np.fromiter(map(get, own), dtype=np.uint64, count=len(own))
            if (found == MANY).any():
                found = np.array([max(2, xxhash.xxh64_intdigest(w)) for w in words(text)], dtype=np.uint64)
            out.append(found[found != NONE])
        return out


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One number per run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ (hashes[k : k + n] * _MULT[k])) * _MULT[(k + 1) % 5]
        out ^= out >> np.uint64(29)
    return out


def shingles(own: list[str], width: int) -> set[str]:
    return {" ".join(own[k : k + width]) for k in range(len(own) - width + 1)}


def signature_size(n: int, share: float) -> int:
    """Smallest hashes that an item of n shingles is known by: one more than a matching text can lack."""
    return n - math.ceil(share * n - 1e-9) + 1


@dataclass
class Partition:
    """Items of one width and about one size: their signatures, sorted, and whose they are."""

    width: int
    least: int
    keys: np.ndarray
    owners: np.ndarray


class Index:
    """The items of one block."""

    def __init__(self, items: list[tuple[object, str]], share: float = SHARE, width: int = WIDTH) -> None:
        self.share, self.ids, self.sets, self.widths = share, [], [], []
        hasher, by = Hasher(), {}
        for item, text in items:
            own = words(text)
            if not own:
                continue
            w = min(width, len(own))
            found = np.unique(shingle_hashes(hasher.texts([text])[0], w))
            by.setdefault((w, int(math.log2(len(found)))), []).append((len(self.ids), len(found), found[: signature_size(len(found), share)]))
            self.ids.append(item)
            self.sets.append(shingles(own, w))
            self.widths.append(w)
        self.partitions = []
        for (w, _), own in sorted(by.items()):
            keys = np.concatenate([k for _, _, k in own])
            owners = np.concatenate([np.full(len(k), at) for at, _, k in own])
            order = np.argsort(keys, kind="stable")
            self.partitions.append(Partition(w, min(math.ceil(share * n - 1e-9) for _, n, _ in own), keys[order], owners[order]))

    def candidates(self, hashes: np.ndarray) -> list[int]:
        found: set[int] = set()
        by_width: dict[int, np.ndarray] = {}
        for part in self.partitions:
            if len(hashes) - part.width + 1 < part.least:
                continue  # too short to hold enough of any item of this partition
            if part.width not in by_width:
                by_width[part.width] = shingle_hashes(hashes, part.width)
            own = by_width[part.width]
            at = np.searchsorted(part.keys, own)
            met = np.unique(own[part.keys[np.minimum(at, len(part.keys) - 1)] == own])
            for key in met:
                a, b = np.searchsorted(part.keys, key), np.searchsorted(part.keys, key, side="right")
                found.update(part.owners[a:b].tolist())
        return sorted(found)

    def matches(self, text: str, hashes: np.ndarray) -> list[tuple[object, int, int]]:
        """Item, shared shingles and the item's shingles, of every item that the text holds enough of."""
        near = self.candidates(hashes)
        if not near:
            return []
        own = words(text)
        held = {w: shingles(own, w) for w in {self.widths[k] for k in near}}
        out = []
        for k in near:
            shared = len(self.sets[k] & held[self.widths[k]])
            if shared >= self.share * len(self.sets[k]) - 1e-9:
                out.append((self.ids[k], shared, len(self.sets[k])))
        return out


def blocks(items: DataFrame, item_col: str, text_col: str, most_bytes: int) -> list[list[tuple[object, str]]]:
    """Items in blocks, each fetched on its own and no larger than about ``most_bytes``."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / most_bytes))
    for k in range(n):
        yield [(r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]


def _scan(index: Index, hasher: Hasher, texts: list[str | None]):
    for a, b in slices(texts):
        part = [t or "" for t in texts[a:b]]
        for k, (text, hashes) in enumerate(zip(part, hasher.texts(part), strict=True), a):
            yield k, index.matches(text, hashes)


def find_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it holds: id, item, ``n_shared``, ``n_shingles``, ``containment`` of at least ``share``.

    Words are runs of letters and digits, lower-cased; items shorter than ``width`` words are one shingle of all their
    words, and items without words, like null texts, match nothing. Items go out in blocks of bounded size and every block
    is one pass over the documents, so nothing is shuffled and any number of items can be searched. Repeated rows give
    repeated rows; other columns are ignored.
    """
    rows = docs.select(id_col, F.col(text_col).alias("text"))
    schema = StructType([rows.schema[id_col], items.schema[item_col]]).simpleString()[len("struct<") : -1]
    kind = pa.int64()

    def scanner(sent, item_type):
        def scan(batches):
            hasher = Hasher()
            for batch in batches:
                out = [(k, *m) for k, found in _scan(sent.value, hasher, batch.column("text").to_pylist()) for m in found]
                row, item, shared, total = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(row, kind)), pa.array(item, item_type), pa.array(shared, kind), pa.array(total, kind), pa.array([s / t for s, t in zip(shared, total, strict=True)], pa.float64())],
                    names=[id_col, item_col, "n_shared", "n_shingles", "containment"],
                )

        return scan

    from pyspark.sql.pandas.types import to_arrow_type

    item_type, found = to_arrow_type(items.schema[item_col].dataType), None
    for block in blocks(items, item_col, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, share, width))
        part = map_batches(rows, scanner(sent, item_type), f"{schema}, n_shared long, n_shingles long, containment double".replace(":", " "))
        found = part if found is None else found.unionAll(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold ``share`` of no item, with all their columns; see :func:`find_contaminated`."""
    at, out = docs.columns.index(text_col), docs
    for block in blocks(items, item_col, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, share, width))

        def clean(batches, sent=sent):
            hasher = Hasher()
            for batch in batches:
                yield batch.filter(pa.array([not found for _, found in _scan(sent.value, hasher, batch.column(at).to_pylist())], pa.bool_()))

        out = map_batches(out, clean, docs.schema)
    return out
