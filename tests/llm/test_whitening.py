"""Whitening against numpy's own eigendecomposition, and the rank-one updates it is made of."""

import os

import numpy as np
import pytest

from plumbline.llm.catalogue import QUERIES
from plumbline.llm.whitening import Moments, Spectrum, rank_one, secular_roots, whiten

ROOT = os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates_with_deflation(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 30))
    d = np.sort(rng.choice([0.0, 1.0, 1.0, 5.0], m) if seed % 2 else rng.exponential(1, m) * 10.0 ** rng.integers(-8, 8, m))
    u = np.linalg.qr(rng.standard_normal((m, m)))[0]
    v = rng.standard_normal(m)
    if seed % 3 == 0:
        v = u[:, rng.integers(m)] * 2
    values, vectors = rank_one(d, u, v)
    whole = (u * d) @ u.T + np.outer(v, v)
    size = np.abs(whole).max()
    assert np.abs((vectors * values) @ vectors.T - whole).max() < 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-12 and (np.diff(values) >= 0).all()


def test_secular_roots_interlace():
    rng = np.random.default_rng(3)
    d = np.cumsum(rng.exponential(1, 40))
    z2 = rng.exponential(1, 40) ** 6 + 1e-12
    near, tau = secular_roots(d, z2)
    roots = d[near] + tau
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(z2, z2))), rtol=1e-10)


def test_spectra_merge_and_travel():
    x = np.random.default_rng(5).standard_normal((300, 7)) * np.geomspace(1, 1e-4, 7) + 100
    parts = [x[:50], x[50:51], x[51:]]
    spectra = []
    for part in parts:
        s = Spectrum(7)
        for row in part:
            s.add(row)
        spectra.append(Spectrum.unpack(np.concatenate(s.pack())))
    for other in spectra[1:]:
        spectra[0].merge(other)
    whole = (x - x.mean(0)).T @ (x - x.mean(0))
    got = (spectra[0].vectors * spectra[0].values) @ spectra[0].vectors.T
    assert spectra[0].n == 300 and np.allclose(spectra[0].mean, x.mean(0)) and np.abs(got - whole).max() < 1e-10
    moments = Moments(7)
    for part in parts:
        moments.add(part)
    assert np.abs(Moments.unpack(np.concatenate(moments.pack())).scatter - whole).max() < 1e-10


def expected(x):
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return ((n * x.astype(object) - total.astype(object)) ** 2).sum(axis=1), centred @ axes[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


@needs_tables
def test_query_is_numpy(spark):
    rows = [r for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in r.embedding] for r in rows], dtype=np.int64)
    deviation, white, explained = expected(x)
    got = {(r.vec_id, r.component): r for r in QUERIES["op13_whitening"](spark, ROOT).collect()}
    assert len(got) == 8 * len(rows) and max(r.identity_error for r in got.values()) < 1e-9
    signs = np.sign([got[rows[0].vec_id, k + 1].whitened * white[0, k] for k in range(8)])
    for i, r in enumerate(rows):
        for k in range(8):
            own = got[r.vec_id, k + 1]
            assert own.n == len(rows) and own.deviation == deviation[i]
            assert own.whitened == pytest.approx(signs[k] * white[i, k], abs=1e-8) and own.explained == pytest.approx(explained[k], rel=1e-9)


def frame(spark, vectors):
    return spark.createDataFrame([(k if k != 2 else None, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "'x' AS x", "'x' AS c", "'x' AS state")


def test_unusable_vectors_go_and_the_rest_is_whole(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(8)
    good = [list(map(float, v)) for v in rng.standard_normal((40, 3))]
    bad = [None, [], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [None, 1.0, 1.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    got = whiten(frame(spark, [*good[:20], *bad, *good[20:], good[0]])).collect()
    assert len(got) == 41 * 3 and {r.n for r in got} == {41} and sum(r.vec_id is None for r in got) == 3
    assert max(r.identity_error for r in got) < 1e-9 and sum(r.explained for r in got if r.vec_id == 0) == pytest.approx(1)


def test_no_variance_and_no_rows(spark):
    one = whiten(frame(spark, [[1.0, 2.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    flat = whiten(frame(spark, [[1.0, 2.0, 0.0], [3.0, 6.0, 0.0], [2.0, 4.0, 0.0]])).collect()
    assert {(r.component, r.explained > 0) for r in flat} == {(1, True), (2, False), (3, False)} and {r.whitened for r in flat if r.component > 1} == {0.0}
    assert whiten(frame(spark, [[1.0]]).limit(0)).collect() == [] and whiten(frame(spark, [None, []])).collect() == []


def test_deviations_beyond_64_bits_are_null(spark):
    got = whiten(frame(spark, [[4e12], [-4e12], [0.0]])).collect()
    assert {r.deviation for r in got if r.whitened != 0} == {None}
    assert {round(abs(r.whitened), 6) for r in got} == {0.0, round((3 / 2) ** 0.5, 6)}
