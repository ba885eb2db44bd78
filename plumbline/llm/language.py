"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import map_batches, slices

BUCKETS = 1 << 15
#: Numbers in a model, languages x buckets: 64 MB, so that it fits the driver and every task whatever the data.
MOST_CELLS = 1 << 23
#: Characters that are counted at once.
WINDOW = 250_000
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def gram_buckets(padded: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character 2- and 3-grams, and where each text's begin (one more entry than texts).

    Texts have two characters at least: they come lower-cased and padded with a blank on both sides.
    """
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(p) for p in padded])
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    two = codes[:-1] * _MULT[0] + codes[1:] * _MULT[1]
    three = two[:-1] * _MULT[2] + codes[2:] * _MULT[0]
    two ^= two >> np.uint32(15)
    three ^= three >> np.uint32(13)
    # grams that begin on a text's last character(s) reach into the next text and are left out
    inside = np.ones(len(codes), dtype=bool)
    inside[ends - 1] = False
    keep2 = inside[: len(two)]
    keep3 = inside[: len(three)].copy()
    keep3[ends[ends - 2 < len(keep3)] - 2] = False
    grams = np.empty((len(codes), 2), dtype=np.uint32)
    used = np.zeros((len(codes), 2), dtype=bool)
    grams[: len(two), 0], used[: len(two), 0] = (two * _MULT[1]) >> shift, keep2
    grams[: len(three), 1], used[: len(three), 1] = (three * _MULT[2]) >> shift, keep3
    counts = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    return grams[used].astype(np.int64), np.concatenate([[0], counts[ends]])


def gram_counts(texts: list[str], buckets: int = BUCKETS, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse counts of grams: rows (numbers of texts, ascending), buckets and counts, a window of characters at a time.

    A text longer than a window is counted in parts that overlap by the two characters of the grams between them.
    """
    for a, b in slices(texts, window):
        own = [f" {t.lower()} " for t in texts[a:b]]
        if b - a > 1 or len(own[0]) <= 2 * window:
            grams, starts = gram_buckets(own, buckets)
            keys, n = np.unique(np.repeat(np.arange(a, b), np.diff(starts)) * buckets + grams, return_counts=True)
            yield keys // buckets, keys % buckets, n
            continue
        for at in range(0, len(own[0]) - 1, window):
            part = own[0][at : at + window + 2]
            n = np.bincount(gram_buckets([part], buckets)[0], minlength=buckets)
            if at + window + 1 < len(own[0]):  # the last pair begins the next part
                n[gram_buckets([part[-2:]], buckets)[0]] -= 1
            bucket = np.flatnonzero(n)
            yield np.full(len(bucket), a), bucket, n[bucket]


def fit_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probability matrix (languages x buckets).

    All labelled rows are counted on the executors: a task sends at most one row per language and bucket, and sums
    are combined before the shuffle. Rows with a null text or language are not learned from; with none left, the
    model is empty. Repeated rows count as often as they occur. The matrix has languages x buckets numbers; more than
    ``MOST_CELLS`` raise an error that asks for fewer buckets.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                by = {}
                for lang, text in zip(langs[a:b], texts[a:b], strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, own in by.items():
                    total = sums.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                    for _, bucket, n in gram_counts(own, buckets):
                        np.add.at(total, bucket, n)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["lang", "bucket", "n"])

    table = map_batches(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    most = MOST_CELLS // buckets
    langs = sorted(r.lang for r in rows.select("lang").distinct().limit(most + 1).collect())
    if len(langs) > most:
        raise ValueError(f"more than {most} languages with {buckets} buckets: ask for fewer buckets")
    counts = np.full((len(langs), buckets), alpha)
    if langs:
        place = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int").alias("place")
        found = table.select(place, "bucket", "n").toPandas()  # at most languages x buckets rows of numbers
        np.add.at(counts, (found["place"].to_numpy(), found["bucket"].to_numpy()), found["n"].to_numpy())
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred`` and ``score``, the posterior probability of that language.

    Every character of the text counts. Null texts, texts without a letter and all texts under an empty model give
    ``und`` with score 0. Ties go to the first language in alphabetical order. Repeated ids give repeated rows; other
    columns are ignored.
    """
    langs, logs = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logs.T)))  # languages x buckets, as checked when fitted

    def predict(batches):
        langs, by_bucket = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            said, scores = ["und"] * len(texts), np.zeros(len(texts))
            for a, b in slices(texts):
                own = [k for k in range(a, b) if langs and has_letter(texts[k])]
                if not own:
                    continue
                sums = np.zeros((len(own), len(langs)))
                for row, bucket, n in gram_counts([texts[k] for k in own], by_bucket.shape[0]):
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    sums[row[first]] += np.add.reduceat(by_bucket[bucket] * n[:, None], first, axis=0)
                sums = np.exp(sums - sums.max(axis=1, keepdims=True))
                sums /= sums.sum(axis=1, keepdims=True)
                for k, best, p in zip(own, sums.argmax(axis=1), sums.max(axis=1), strict=True):
                    said[k], scores[k] = langs[best], p
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(said, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    rows = docs.select(id_col, F.col(text_col).alias("text"))
    return map_batches(rows, predict, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
