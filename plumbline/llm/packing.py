"""Best-fit packing of token sequences under several capacities at once.

Bins have residual capacities in three dimensions: tokens, documents and attention cost (the sum of squared piece lengths).
A piece goes into a bin that can take it in every dimension; among those, into the one with the largest weighted
dot-product of demand and residual, or the smallest norm of what would be left.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import held, keep, map_batches, ship, slices, uncollected
from plumbline.llm.tokens import Memo

#: Pieces that are packed together. Each group ends with at most a few bins that are not full, one in thousands.
GROUP = 16_384


class Encoder(Memo):
    """Token ids of whole texts for a vocabulary that lower-cases and whose pattern drops white space.

    No token reaches across white space, so a text's ids are those of its words in turn. Texts with special strings or
    with control characters that Python splits at are encoded whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path, fold=True)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [None if self.odd(t) else t.split() for t in texts]
        self.learn(set().union(*filter(None, words)))
        get = self.memo.__getitem__
        return [self.encode(t) if own is None else b"".join(map(get, own)) for t, own in zip(texts, words, strict=True)]


def encoder(path: str) -> Encoder:
    return held(("ids", path), lambda: Encoder(path))


def token_pieces(docs: DataFrame, path: str, most_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ``ids_crc32``. Each text's ids end with ``end_id``; null counts as empty."""

    def cut(batches):
        own, tail = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for a, b in slices(texts, 500_000):
                with uncollected():
                    found = own.ids(texts[a:b])
                for k, ids in enumerate(found, a):
                    ids += tail
                    for n, at in enumerate(range(0, len(ids), 4 * most_tokens)):
                        part = ids[at : at + 4 * most_tokens]
                        row.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(id_col, F.col(text_col).alias("text"))
    return map_batches(rows, cut, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, tokens: int = 2048, documents: int = 2048, attention: int = 2048 * 2048, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.2)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each piece; longest pieces first, a new bin only where no open one can take the piece.

    ``rule`` is ``norm`` (smallest weighted norm of the residual after placing) or ``dot`` (largest weighted dot-product of
    demand and residual). All capacities hold in every bin; a single piece that breaks one raises. Ties go to the bin
    opened first. Bins that no remaining piece can enter are closed.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be 'norm' or 'dot'")
    lengths = np.asarray(lengths, dtype=np.int64)
    caps = np.array([tokens, documents, attention], dtype=np.float64)
    if len(lengths) and (lengths.max() > tokens or lengths.max() ** 2 > attention or documents < 1):
        raise ValueError("a piece is larger than an empty bin")
    scale = np.array(weights) / caps**2
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 0
    bins, places = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    left = np.empty((3, max(64, len(lengths) // 8)))
    name = np.empty(left.shape[1], dtype=np.int64)
    n = opened = 0
    for k in order:
        size = int(lengths[k])
        need = np.array([size, 1, size * size], dtype=np.float64)
        open_ = left[:, :n]
        fits = np.flatnonzero((open_[0] >= need[0]) & (open_[1] >= 1) & (open_[2] >= need[2]))
        if len(fits):
            own = open_[:, fits]
            score = (scale[:, None] * (own - need[:, None]) ** 2).sum(axis=0) if rule == "norm" else -((scale * need)[:, None] * own).sum(axis=0)
            at = int(fits[score.argmin()])
        else:
            if n == left.shape[1]:
                left, name = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([name, np.empty_like(name)])
            left[:, n], name[n], at = caps, opened, n
            n, opened = n + 1, opened + 1
        bins[k], places[k] = name[at], tokens - left[0, at]
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:
            n -= 1
            left[:, at : n], name[at:n] = left[:, at + 1 : n + 1].copy(), name[at + 1 : n + 1].copy()
    return bins, places


def pack(pieces: DataFrame, tokens: int = 2048, documents: int = 2048, attention: int = 2048 * 2048, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """``pieces`` (a table, as it is read more than once) with ``sequence_id`` and ``offset``.

    Rows are dealt into groups of about ``group`` pieces by a hash of the row and its place in the table, so none depends on a
    source or a document, copies of one row are spread as well, and every group is packed by :func:`best_fit` on its own. Full pieces are sequences by themselves. Sequence numbers are
    unique, not consecutive. Repeated rows are placed in turn; an empty table stays empty.
    """
    groups = max(1, -(-pieces.count() // group))
    schema = pieces.schema.simpleString()[len("struct<") : -1]
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64(*pieces.columns, F.monotonically_increasing_id()), F.lit(groups)))

    def one(frame):
        frame = frame.sort_values(["length", *[c for c in frame.columns if c != "length"]], ascending=False)
        bins, places = best_fit(frame["length"].to_numpy(), tokens, documents, attention, rule)
        out = frame.drop(columns="deal")
        out["sequence_id"], out["offset"] = frame["deal"].to_numpy(dtype=np.int64) * (1 << 32) + bins, places
        return out

    ship(pieces)
    return dealt.groupBy("deal").applyInPandas(one, f"{schema}, sequence_id long, offset long".replace(":", " "))


def pack_documents(docs: DataFrame, path: str, most_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text", documents: int | None = None, attention: int | None = None, rule: str = "norm") -> DataFrame:
    """All pieces of all texts with their places: :func:`token_pieces`, kept in a table, then :func:`pack`.

    By default only tokens limit a sequence: as many pieces as tokens and a cost of tokens squared are never exceeded.
    ``documents`` and ``attention`` set tighter limits; pieces are then cut no longer than the cost of one allows. A null id
    stays null, repeated rows are packed each on their own, other columns are ignored.
    """
    documents, attention = most_tokens if documents is None else documents, most_tokens**2 if attention is None else attention
    longest = min(most_tokens, math.isqrt(attention))
    pieces = keep(token_pieces(docs, path, longest, id_col=id_col, text_col=text_col), "token-pieces")
    return pack(pieces, most_tokens, documents, attention, rule)
