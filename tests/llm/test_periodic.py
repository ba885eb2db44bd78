"""Periodic runs against brute force over every period."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm.catalogue import QUERIES
from plumbline.llm.periodic import find_runs, gram_length, run_digests, runs_of, with_cycles

ROOT = os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")


def brute(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(least, times * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, len(stretch), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng):
    out = []
    for _ in range(rng.randint(1, 4)):
        words: list[int] = []
        while len(words) < rng.randint(0, 250):
            letters = rng.choice([1, 2, 2, 3, 50])
            if rng.random() < 0.5:
                unit = [rng.randrange(letters) for _ in range(rng.randint(1, rng.choice([3, 9, 20, 40])))]
                words += (unit * rng.randint(1, 9))[: rng.randint(1, 300)]
            else:
                words += [rng.randrange(letters) for _ in range(rng.randint(1, 40))]
        out.append(words[:300])
    return out


@pytest.mark.parametrize(("least", "times"), [(24, 3), (10, 3), (6, 4), (40, 3), (3, 3)])
def test_runs_are_those_of_brute_force(least, times):
    rng, found = random.Random(least), 0
    for _ in range(120):
        own = texts(rng)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
        want = sorted(((s + int(bounds[k]), n, q) for k, t in enumerate(own) for s, n, q in brute(t, least, times)), key=lambda r: (r[0], r[2]))
        flat = np.array([w for t in own for w in t], dtype=np.int64)
        assert (runs_of(flat, bounds, least, times) if len(flat) else []) == want
        found += len(want)
    assert found > 50


def test_grams_are_as_long_as_every_overlap_and_every_period():
    for level in range(12):
        for q in range(1 << level, 2 << level):
            assert q <= gram_length(level) <= max(24, 3 * q) - q


def test_periods_too_few_to_fix_are_refused():
    with pytest.raises(ValueError, match="times"):
        runs_of(np.zeros(50, dtype=np.int64), np.array([0, 50]), 24, 2)


def test_one_text_of_half_a_million_words():
    words = np.tile(np.random.default_rng(1).integers(0, 9, 1000), 500)
    assert runs_of(words, np.array([0, len(words)]))[0] == (0, 500_000, 1000)
    assert runs_of(np.zeros(500_000, dtype=np.int64), np.array([0, 500_000])) == [(0, 500_000, 1)]


@needs_tables
def test_query_is_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, ROOT).collect()}
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if n > 2500:
            continue
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        said = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        milli = 1000 * best[1] // best[2] if runs else None
        assert got[doc_id] == (len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_edges(edge_docs, no_docs):
    got = run_digests(find_runs(with_cycles(edge_docs)))
    rows = got.collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == edge_docs.count()
    assert {tuple(r)[1:] for r in rows if r.doc_id in (2, 3, 4)} == {(0, None, None, None, None, empty, empty)}
    assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 1 for r in rows) == 2
    assert run_digests(find_runs(with_cycles(no_docs))).collect() == []
    again = edge_docs.selectExpr("doc_id", "repeat('to be or ', 30) AS text")
    assert {(r.n_words, r.runs[0].period, r.kept) for r in find_runs(again).collect()} == {(90, 3, "to be or")}
