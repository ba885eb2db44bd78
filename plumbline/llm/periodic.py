"""Periodic runs of words: seed-and-extend along the diagonals of each text.

A run is a stretch of consecutive words with a smallest period that repeats at least ``times`` times over at least ``least``
words. Lags are taken in classes from one power of two to the next. A run whose period lies in a class matches itself at
that lag over a guaranteed overlap, and word grams of that length are indexed: as the gram is at least as long as the
period, its next occurrence within the run lies exactly one period ahead, so neighbouring occurrences in one text are all
the pairs that need looking at. Each pair is a seed on the diagonal of its lag. A table holds how far every lag is covered
already, seeds below that are skipped, and the others are extended both ways word by word.
"""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import map_batches, slices

LEAST, TIMES = 24, 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def gram_length(level: int, least: int = LEAST, times: int = TIMES) -> int:
    """Words that a run with a period in [2^level, 2^(level+1)) surely shares with itself one period ahead."""
    return min(max(least - q, (times - 1) * q) for q in range(1 << level, min(2 << level, max(2 * least, (1 << level) + 1))))


def _names(values: np.ndarray) -> np.ndarray:
    return pd.factorize(values)[0].astype(np.int64)


def _seeds(words: np.ndarray, ends: np.ndarray, least: int, times: int):
    """Pairs of neighbouring occurrences (places, lags) of equal grams in one text, class by class.

    ``ends`` holds the end of the text of each place. Grams are named exactly, by doubling, from the second round on only
    where their first half occurs twice in its text.
    """
    def shortest(level):
        return min(gram_length(k, least, times) for k in range(level, max(level, least.bit_length()) + 1))

    base = 1
    while 2 * base <= shortest(0):
        base *= 2
    at = np.arange(len(words))
    name, size = words, 1

    def double(name, size):
        """Names of the grams of twice the size; -1 where a half has none or the text ends."""
        out = np.full(len(words), -1, dtype=np.int64)
        i = np.flatnonzero((name >= 0) & (at + 2 * size <= ends))
        i = i[name[i + size] >= 0]
        if len(i):
            out[i] = _names(name[i] * (int(name.max()) + 1) + name[i + size])
        return out

    def repeated(i, names):
        """Places in order of gram and place, and the lag to the next occurrence in the same text (0: none)."""
        order = np.lexsort((i, names))
        i, names = i[order], names[order]
        same = (names[1:] == names[:-1]) & (ends[i[1:]] == ends[i[:-1]])
        return i, np.append(np.where(same, i[1:] - i[:-1], 0), 0).astype(np.int64)

    while size < base:
        name, size = double(name, size), 2 * size
    level = 0
    while True:
        length = gram_length(level, least, times)
        while 2 * size <= shortest(level):
            # a gram that occurs once in its text begins no longer one that occurs twice
            i, lags = repeated(np.flatnonzero(name >= 0), name[name >= 0])
            again = lags > 0
            again[1:] |= lags[:-1] > 0
            lone = np.ones(len(words), dtype=bool)
            lone[i[again]] = False
            name = np.where(lone, -1, name)
            name, size = double(name, size), 2 * size
        if not (name >= 0).any():
            return
        i = np.flatnonzero((name >= 0) & (at + length <= ends))
        own, reach = name[i], size
        while reach < length:
            step = min(reach, length - size)
            whole = name[i + step] >= 0
            i, own, reach = i[whole], own[whole], step + size
            own = _names(own * (int(name.max()) + 1) + name[i + step]) if len(i) else own
        if len(i):
            i, lags = repeated(i, own)
            keep = (lags >= 1 << level) & (lags < 2 << level)
            order = np.argsort(i[keep], kind="stable")
            yield i[keep][order], lags[keep][order], length
        level += 1


def _ahead(words: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words from ``a`` and ``b`` on are equal, before ``end``."""
    n, step = 0, 64
    while b + n < end:
        here = min(step, end - b - n)
        differ = np.flatnonzero(words[a + n : a + n + here] != words[b + n : b + n + here])
        if len(differ):
            return n + int(differ[0])
        n, step = n + here, 2 * step
    return n


def _behind(words: np.ndarray, a: int, b: int, begin: int) -> int:
    """How many words before ``a`` and ``b`` are equal, ``a`` staying at or after ``begin``."""
    n, step = 0, 64
    while a - n > begin:
        here = min(step, a - n - begin)
        differ = np.flatnonzero(words[a - n - here : a - n] != words[b - n - here : b - n])
        if len(differ):
            return n + here - 1 - int(differ[-1])
        n, step = n + here, 2 * step
    return n


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs (start, length, smallest period) in texts laid end to end; text ``k`` is words ``bounds[k]`` to ``bounds[k + 1]``.

    Words are numbers from 0. Starts count from the first word of all; no run crosses a bound.
    """
    if times < 3:
        raise ValueError("times must be 3 or more: shorter overlaps do not fix a period")
    ends = np.repeat(bounds[1:], np.diff(bounds))
    begins = np.repeat(bounds[:-1], np.diff(bounds))
    out = []
    for places, lags, length in _seeds(words, ends, least, times):
        covered: dict[int, int] = {}
        # seeds right behind another one of their lag are covered by it
        order = np.lexsort((places, lags))
        p, q = places[order], lags[order]
        first = np.ones(len(p), dtype=bool)
        first[1:] = (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)
        for i, lag in zip(p[first].tolist(), q[first].tolist(), strict=True):
            if i < covered.get(lag, 0):
                continue
            start = i - _behind(words, i, i + lag, int(begins[i]))
            end = i + lag + length + _ahead(words, i + length, i + lag + length, int(ends[i]))
            covered[lag] = end - lag
            if end - start >= max(least, times * lag):
                out.append((start, end - start, lag))
    return sorted(out, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``n_words``, ``runs`` by start and period, ``strongest`` (the run with the greatest length / period;
    ties: smallest start, then period) and ``kept``, the words outside every run's later periods, joined by one blank.

    Words are parted by blanks, tabs and line breaks (9 to 13). A run is a stretch that no neighbouring word extends, of
    ``least`` words and ``times`` of its smallest period at least; a word is left out of ``kept`` if a run holds it after the
    run's first period. Null and empty texts have no words, no runs, a null ``strongest`` and an empty ``kept``. Null ids are
    kept, repeated rows are rows of their own, an empty table gives an empty result, other columns are ignored. The work per
    text is n log n whatever it repeats, so one text of millions of words needs no splitting.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                words = [_WORD.findall(t) if t else [] for t in texts[a:b]]
                bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                flat = np.array([w for own in words for w in own] + [None], dtype=object)[:-1]
                found = runs_of(pd.factorize(flat)[0].astype(np.int64), bounds, least, times) if len(flat) else []
                own: list[list] = [[] for _ in words]
                drop: dict[int, np.ndarray] = {}
                for start, length, period in found:
                    k = int(np.searchsorted(bounds, start, side="right")) - 1
                    start -= int(bounds[k])
                    own[k].append((start, length, period))
                    drop.setdefault(k, np.zeros(len(words[k]), dtype=bool))[start + period : start + length] = True
                best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else None for r in own]
                kept = [" ".join([x for x, d in zip(w, drop[k].tolist(), strict=True) if not d] if k in drop else w) for k, w in enumerate(words)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in own], pa.list_(_RUN)),
                        pa.array([dict(zip(("start", "length", "period"), r, strict=True)) if r else None for r in best], _RUN),
                        pa.array(kept, pa.string()),
                    ],
                    names=[id_col, "n_words", "runs", "strongest", "kept"],
                )

    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema[0].dataType.simpleString()
    return map_batches(source, run, f"`{id_col}` {kind}, n_words bigint, runs array<{RUN}>, strongest {RUN}, kept string")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what ``find_runs`` found: one row per row."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return found.select(
        F.col(id_col), F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("kept"), 256).alias("collapsed_sha256"),
    )


def with_cycles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and text of all rows; from one row in ten, chosen by its id's checksum, a tail repeats itself.

    With h the id's crc32 and g = h div 10, where h is a multiple of 10 and the text has n > 0 words, each word from a = g mod n
    on is replaced by word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Rows without an id stay as they are.
    """
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(id_col).cast("string"))
    source = docs.select(F.col(id_col), F.col(text_col), F.when(h % 10 == 0, words).alias("w"), F.expr("0L").alias("g")).withColumn("g", F.floor(h / 10))
    sized = source.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cycle = sized.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    changed = F.expr("array_join(transform(sequence(0, n - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' ')")
    return cycle.select(F.col(id_col), F.when(F.col("n") > 0, changed).otherwise(F.col(text_col)).alias(text_col))
