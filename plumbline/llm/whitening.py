"""Whitening of embeddings by incremental eigendecomposition.

Every task keeps the spectrum of the vectors it has seen: each new vector is a centred rank-one update of the scatter
matrix, solved through its secular equation after deflation. Spectra of tasks are combined in a tree, one rank-one update
per eigenvector of the other spectrum and one for the distance of the two means. Rounding adds up over so many updates, so
a last distributed pass projects the covariance onto the basis found (Rayleigh-Ritz), which makes it exact to double
precision. Only matrices of dimensions x dimensions reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import keep, map_batches, ship

SCALE, SHIFT = 1024, 100_000
#: Components returned.
MOST = 8
#: States that one task of a tree combines.
FAN = 16
#: Components whose eigenvalue is below this share of the trace have no variance that double precision could tell from none.
FLAT = 1e-13
_EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x), as the pole next to each and the distance from it; ``d`` strictly ascending, z2 > 0.

    One root lies behind every pole. Each step replaces the poles on either side by one with matching slope, solves the
    quadratic that leaves, and falls back to halving the bracket.
    """
    m = len(d)
    above = np.append(d[1:], d[-1] + z2.sum())
    half = (above - d) / 2
    at_half = 1 + (z2 / (d[None, :] - d[:, None] - half[:, None])).sum(axis=1)
    near = np.where((at_half >= 0) | (np.arange(m) == m - 1), np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    origin = d[near]
    poles = d[None, :] - origin[:, None]
    left, right = d - origin, above - origin
    lo = np.where(at_half >= 0, left, left + half)
    hi = np.where(at_half >= 0, left + half, right)
    tau = (lo + hi) / 2
    open_ = np.arange(m)
    gap_from, before = poles, np.tri(m)
    for _ in range(80):
        t = tau[open_]
        gap = gap_from - t[:, None]
        term = z2 / gap
        slope = term / gap
        f = 1 + term.sum(axis=1)
        rough = 1 + np.abs(term).sum(axis=1)
        lo[open_], hi[open_] = np.where(f < 0, t, lo[open_]), np.where(f < 0, hi[open_], t)
        own_lo, own_hi = lo[open_], hi[open_]
        one, two = left[open_] - t, right[open_] - t
        psi, whole = (slope * before).sum(axis=1), slope.sum(axis=1)
        a = (one + two) * f - one * two * whole
        b = one * two * f
        c = f - one * psi - two * (whole - psi)
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = t + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = np.where(np.isfinite(new) & (new > own_lo) & (new < own_hi), new, (own_lo + own_hi) / 2)
        going = (np.abs(f) > 4 * _EPS * rough) & (own_hi - own_lo > 2 * _EPS * np.maximum(np.abs(own_lo), np.abs(own_hi)))
        open_ = open_[going]
        if not len(open_):
            break
        tau[open_] = new[going]
        if len(open_) < len(going):
            gap_from, before = gap_from[going], before[going]
    return near, tau


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of u diag(d) u' + v v'."""
    z = u.T @ v
    norm2 = float(z @ z)
    if norm2 == 0:
        return d, u
    tol = 8 * _EPS * max(float(np.abs(d).max()), norm2)
    # equal eigenvalues: a reflection leaves one of them with all of the update
    cuts = np.flatnonzero(np.diff(d) > tol) + 1
    if len(cuts) + 1 < len(d):
        u = u.copy()
        for g in np.split(np.arange(len(d)), cuts):
            if len(g) > 1 and (size := float(np.linalg.norm(z[g]))) > 0:
                w = z[g].copy()
                w[-1] += math.copysign(size, w[-1])
                w /= np.linalg.norm(w)
                u[:, g] -= 2 * np.outer(u[:, g] @ w, w)
                last = -math.copysign(size, z[g[-1]])
                z[g] = 0
                z[g[-1]] = last
    # directions that the update does not touch stay as they are
    on = np.flatnonzero(np.abs(z) * math.sqrt(norm2) > tol)
    if not len(on):
        return d, u
    own, weight = d[on], z[on] ** 2
    near, tau = secular_roots(own, weight)
    distance = own[None, :] - own[near][:, None] - tau[:, None]
    apart = own[None, :] - own[:, None]
    np.fill_diagonal(apart, 1.0)
    # weights for which the roots found are exact give orthogonal vectors
    exact = np.sqrt(np.prod(np.abs(distance) / np.abs(apart), axis=0)) * np.sign(z[on])
    turn = exact[:, None] / distance.T
    turn /= np.linalg.norm(turn, axis=0)
    values, vectors = d.copy(), u.copy() if u.base is None else np.array(u)
    values[on] = own[near] + tau
    vectors[:, on] = u[:, on] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter of the vectors seen so far."""

    def __init__(self, dim: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away * math.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * math.sqrt(value))
        away = other.mean - self.mean
        if self.n and other.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, away * math.sqrt(self.n * other.n / (self.n + other.n)))
        self.n += other.n
        self.mean = self.mean + away * (other.n / self.n)

    def pack(self) -> list[np.ndarray]:
        return [np.array([self.n], dtype=np.float64), self.mean, self.values, self.vectors.reshape(-1)]

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Spectrum:
        dim = math.isqrt(len(flat))
        dim -= dim * dim + 2 * dim + 1 > len(flat)
        out = cls(dim)
        out.n, out.mean, out.values = int(flat[0]), flat[1 : 1 + dim], flat[1 + dim : 1 + 2 * dim]
        out.vectors = flat[1 + 2 * dim :].reshape(dim, dim)
        return out


class Moments:
    """Count, mean and scatter, taken around the mean."""

    def __init__(self, dim: int):
        self.n, self.mean, self.scatter = 0, np.zeros(dim), np.zeros((dim, dim))

    def add(self, rows: np.ndarray) -> None:
        other = Moments(rows.shape[1])
        other.n, other.mean = len(rows), rows.mean(axis=0)
        centred = rows - other.mean
        other.scatter = centred.T @ centred
        self.merge(other)

    def merge(self, other: Moments) -> None:
        away, n = other.mean - self.mean, self.n + other.n
        self.scatter = self.scatter + other.scatter + np.outer(away, away) * (self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.n = n

    def pack(self) -> list[np.ndarray]:
        return [np.array([self.n], dtype=np.float64), self.mean, self.scatter.reshape(-1)]

    @classmethod
    def unpack(cls, flat: np.ndarray) -> Moments:
        dim = math.isqrt(len(flat))
        dim -= dim * dim + dim + 1 > len(flat)
        out = cls(dim)
        out.n, out.mean, out.scatter = int(flat[0]), flat[1 : 1 + dim], flat[1 + dim :].reshape(dim, dim)
        return out


def _arrays(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _fold(rows: DataFrame, dim: int, kind: type, feed: Callable[[object, np.ndarray], None]):
    """One state per task over all rows, combined in a tree of groups of ``FAN``; None for an empty table."""

    def partial(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                state = state or kind(dim if kind is Spectrum else feed(None, _arrays(batch, dim)[:1]).shape[1])
                feed(state, _arrays(batch, dim))
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.concatenate(state.pack())], pa.list_(pa.float64()))], names=["place", "state"]
            )

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        states = [kind.unpack(np.asarray(s, dtype=np.float64)) for s in frame.sort_values("place")["state"]]
        for other in states[1:]:
            states[0].merge(other)
        return pd.DataFrame({"place": [int(frame["place"].min()) // FAN], "state": [np.concatenate(states[0].pack())]})

    states = keep(map_batches(rows, partial, "place long, state array<double>"), "states")
    while (n := states.count()) > 1:
        ship(states)
        states = keep(states.groupBy(F.expr(f"place div {FAN}")).applyInPandas(combine, "place long, state array<double>"), "states")
    return kind.unpack(np.array(states.first()["state"], dtype=np.float64)) if n else None


def _apply(state, rows: np.ndarray, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    out = project(rows)
    if state is not None:
        state.add(out)
    return out


def whiten(vectors: DataFrame, most: int = MOST, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable row and component (from 1, by falling eigenvalue, up to ``most``): id, ``component``, ``n`` (usable rows),
    ``deviation`` (sum over dimensions of (n x - S)^2, exact), ``whitened`` (the centred vector along the component, over the
    component's deviation), ``explained`` (its share of the variance) and ``identity_error`` (largest absolute entry of the
    whitened vectors' covariance minus the identity).

    Vectors become integers x = floor(scale c) + shift; S is their sum. Null vectors, those with null or non-finite entries
    or with entries beyond 2^52 / scale, and those of another length than the most frequent one (ties: the shorter) are
    dropped; so are vectors without entries. Repeated rows count as often as they occur, ids may be null. Vectors with fewer
    dimensions than ``most`` have fewer components. A component without variance (a single row, equal rows, dependent
    dimensions) has whitened and explained values of 0 and is left out of ``identity_error``, which is 0 where there is no
    other. A ``deviation`` beyond 64 bits is null. An empty table gives an empty result, other columns are ignored.
    """
    c = F.col("c").cast("array<double>")
    bound = float(2**52 // scale)
    usable = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("c")).where(F.size("c") > 0).where(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & F.abs(e).between(0.0, bound)))
    lengths = usable.groupBy(F.size("c").alias("k")).count().orderBy(F.desc("count"), "k").limit(1).collect()
    kind = usable.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = lengths[0]["k"] if lengths else 0
    rows = usable.where(F.size("c") == dim).select("id", F.transform(c, lambda e: F.floor(e * scale) + shift).cast("array<long>").alias("x"))
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)

    def totals(batches):
        n, high, low = 0, np.zeros(dim, dtype=np.int64), np.zeros(dim, dtype=np.int64)
        for batch in batches:
            x = _arrays(batch, dim)
            n, high, low = n + len(x), high + (x >> 24).sum(axis=0), low + (x & 0xFFFFFF).sum(axis=0)
        if n:
            sums = [str((int(h) << 24) + int(w)) for h, w in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(sums, pa.string())], names=["at", "n", "total"])

    summed = map_batches(rows.select("x"), totals, "at int, n long, total string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    n, sums = summed[0]["n"], [int(r["total"]) for r in sorted(summed, key=lambda r: r["at"])]
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s - n * w) / n for s, w in zip(sums, whole.tolist(), strict=True)])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - rest

    def feed(state: Spectrum, x: np.ndarray) -> None:
        for row in centred(x):
            state.add(row)

    rough = _fold(rows.select("x"), dim, Spectrum, feed)
    basis = np.linalg.qr(rough.vectors)[0]
    exact = _fold(rows.select("x"), dim, Moments, lambda state, x: _apply(state, x, lambda r: centred(r) @ basis))
    values, turn = np.linalg.eigh(exact.scatter / n)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    many = min(most, dim)
    varied = (values > FLAT * trace) & (trace > 0)
    explained = np.where(varied, values / trace if trace > 0 else 0.0, 0.0)[:many]
    loads = np.where(varied, axes / np.sqrt(np.where(varied, values, 1.0)), 0.0)[:, :many]
    live = int(varied[:many].sum())
    error = 0.0
    if live:
        white = _fold(rows.select("x"), dim, Moments, lambda state, x: _apply(state, x, lambda r: centred(r) @ loads[:, :live]))
        error = float(np.abs(white.scatter / n - np.eye(live)).max())

    def deviations(x: np.ndarray) -> list:
        away = x - whole
        small = n * float(np.abs(away).max(initial=0)) + n < 2**62 / dim / max(n * float(np.abs(away).max(initial=0)) + n, 1.0)
        if small:
            own = away * n - np.array([s - n * w for s, w in zip(sums, whole.tolist(), strict=True)], dtype=np.int64)
            return (own * own).sum(axis=1).tolist()
        found = [sum((n * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [d if d < 2**63 else None for d in found]

    def finish(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _arrays(part, dim)
                size = len(x)
                at = np.repeat(np.arange(size), many)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), size)), pa.array(np.full(len(at), n, dtype=np.int64)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(at)), pa.array((centred(x) @ loads).reshape(-1)), pa.array(np.tile(explained, size)), pa.array(np.full(len(at), error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return map_batches(rows, finish, schema)
