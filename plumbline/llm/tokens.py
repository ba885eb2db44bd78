"""Token counts through a digest cache, and encoding that meets each distinct piece of text once per worker."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import held, map_batches, new_path, slices, uncollected

#: Entries a worker's memory of pieces may hold; when full it starts anew, which costs time only.
MEMO = 1_000_000
#: White space as Unicode has it; the separators U+001C to U+001F, which Python adds, are not in it.
_WHITE = "\t\n\x0b\x0c\r\x20\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_PIECES = re.compile(rf"\x20?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
_ODD = re.compile("[\x1c-\x1f]")
#: Letters whose lower case depends on their neighbours or is more than one letter.
_UNLIKE = re.compile("[\u03a3\u0130]")
_TAIL = ".,!?;:|#*$%&"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def encode_distinct(path: str, pieces: list[str], at_once: int = 2000) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each piece; no piece may hold a special string.

    Many pieces go through the library as one text with a special string between each two: it cuts the text before
    anything else is done to it, and its id marks where a piece's ids end.
    """
    own, special = tokenizer(path), special_strings(path)
    if not special:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in own.encode_batch_fast(pieces, add_special_tokens=False)]
    mark, out = own.token_to_id(special[0]), []
    for a in range(0, len(pieces), at_once):
        ids = np.array(own.encode_batch_fast([special[0].join(pieces[a : a + at_once])], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts, data = np.flatnonzero(ids == mark).tolist(), ids.tobytes()
        out += [data[4 * x + 4 : 4 * y] for x, y in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
    return out


class Memo:
    """Ids of words or pieces of text (never empty), each met by the tokenizer once while it is remembered.

    A piece that ends in punctuation after a letter or digit is put together from two, as both vocabularies' patterns
    always cut there; ``fold`` may lower-case pieces where the vocabulary does so itself.
    """

    def __init__(self, path: str, fold: bool = False) -> None:
        self.path, self.fold, self.memo = path, fold, {}

    def _parts(self, piece: str) -> tuple[str, ...]:
        if self.fold:
            if piece.isascii():
                piece = piece.lower()
            elif _UNLIKE.search(piece):
                return (piece,)
            else:
                low = piece.lower()
                piece = low if is_normalized("NFC", piece) and is_normalized("NFC", low) else piece
        if piece[-1] in _TAIL:
            stem = piece.rstrip(_TAIL)
            if stem and stem[-1].isalnum():
                return stem, piece[len(stem) :]
        return (piece,)

    def learn(self, pieces: set[str]) -> None:
        memo = self.memo
        if len(memo) + len(pieces) > MEMO:  # short pieces are the ones that come again
            memo = self.memo = {k: v for k, v in memo.items() if len(k) <= 7} if len(memo) > len(pieces) else {}
        made, fresh = [], set()
        for piece in pieces.difference(memo):
            parts = self._parts(piece)
            if parts[0] is not piece:
                made.append((piece, parts))
            fresh.update(parts)
        fresh = list(fresh.difference(memo))
        memo.update(zip(fresh, encode_distinct(self.path, fresh), strict=True))
        for piece, parts in made:
            memo[piece] = memo[parts[0]] if len(parts) == 1 else memo[parts[0]] + memo[parts[1]]

    def odd(self, text: str) -> bool:
        """Must this text be encoded whole?"""
        return _ODD.search(text) is not None or any(s in text for s in special_strings(self.path))

    def encode(self, text: str) -> bytes:
        return np.array(tokenizer(self.path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Counter(Memo):
    """Token counts of whole texts for a byte-level vocabulary.

    Its splitting pattern never joins text across the pieces cut here (a word with the blank before it, or white space),
    so a text's count is the sum over its pieces. Texts with special strings, whose places cut the text first, and with
    control characters that Python and the pattern see differently are encoded whole.
    """

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [None if self.odd(t) else _PIECES.findall(t) for t in texts]
        self.learn(set().union(*filter(None, pieces)))
        get = self.memo.__getitem__
        return [(len(self.encode(t)) if p is None else sum(map(len, map(get, p)))) // 4 for t, p in zip(texts, pieces, strict=True)]


def counter(path: str) -> Counter:
    return held(("counts", path), lambda: Counter(path))


def version(path: str) -> str:
    """Digest of the tokenizer's file: another file, another version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def token_counts(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text under the tokenizer in the file ``path``.

    Contents are known by their SHA-256, after the only normalisation that leaves counts as they are: null counts as
    empty. ``cache`` is a folder of Parquet files (tokenizer version, digest, count) that all executors reach; counts found
    there are not made again, one row of each other digest is encoded, and the new counts are appended. None takes a new
    folder for this call. Two runs may append the same digest; either copy serves. Repeated rows give repeated rows, an
    empty table an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-cache")
    which = version(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    spark.createDataFrame([], "tokenizer string, digest binary, n_tokens int").write.mode("append").parquet(cache)
    schema = spark.read.parquet(cache).schema
    stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == which)
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    # the row with the digest's smallest id, found on digests alone, so that no other copy of a text is encoded
    first = own.groupBy("digest").agg(F.min("id").alias("id")).join(stored.select("digest"), "digest", "left_anti")
    misses = own.alias("o").join(first.alias("f"), (F.col("o.digest") == F.col("f.digest")) & F.col("o.id").eqNullSafe(F.col("f.id"))).select("o.text", "o.digest")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for a, b in slices(texts, 500_000):
                with uncollected():
                    out += count.counts(texts[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([which] * len(out), pa.string()), batch.column("digest"), pa.array(out, pa.int32())], names=["tokenizer", "digest", "n_tokens"])

    map_batches(misses, encode, "tokenizer string, digest binary, n_tokens int").write.mode("append").parquet(cache)
    known = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == which).groupBy("digest").agg(F.max("n_tokens").cast("long").alias("n_tokens"))
    return rows.join(known, "digest", "left").select(id_col, "n_bytes", "n_tokens")
