"""Whitening of embeddings by an incremental eigendecomposition.

An entry c becomes the whole number x = floor(64 c) + 1000000. The model is
fitted on each distinct x vector once: count n, sums S, covariance V (divisor
n, centred before multiplying), its unit eigenvectors by falling eigenvalue.

1. Each partition keeps the eigenvalues and eigenvectors of its scatter matrix
   and takes in vector after vector as a rank-one update centred on the running
   mean: the secular equation is solved for all new eigenvalues, after deflation
   of directions that the update does not touch and of eigenvalues that agree,
   and the eigenvectors follow from the solved z (Gu and Eisenstat), so that
   they stay orthogonal.
2. Spectra are combined in groups of FAN_IN, round by round: one more rank-one
   update for each eigenpair of the other spectrum and one for the difference
   of the means.
3. Rayleigh-Ritz: the combined eigenvectors, made orthonormal again, are the
   basis in which the covariance is summed over all vectors anew; its
   eigenvectors turn the basis. As the basis is complete this gives V's
   eigenvectors to double precision, whatever rounding the updates gathered.

A task holds matrices of dimension squared and a batch of vectors; the driver
gets one spectrum and one matrix of that size.

Rows whose vector is null, empty or holds a null, NaN or infinite entry are
dropped. 64 c beyond 2^61 in size counts as 2^61. Vectors of different lengths
raise ValueError. Repeated vectors and ids get rows of their own and count once in the fit.
Directions without variance (eigenvalue under 1e-12 of the greatest) have no
whitened value and are left out: a table of one distinct vector, like an empty
one, gives no rows. A deviation beyond a long is null. Other columns are not
read, so their names and types are free. With equal eigenvalues any basis of
their space is right, and one is used for all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, staged

SCALE, SHIFT, EDGE = 64, 1_000_000, float(1 << 61)
FAN_IN = 8
COMPONENTS = 16
NO_VARIANCE = 1e-12
ROWS_AT_ONCE = 2048
EPS = np.finfo(float).eps
SPECTRUM = ("part long, n long, origin array<long>, mean array<double>, high array<long>, low array<long>,"
            " values array<double>, vectors array<double>")


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_i^2 / (d_i - t)), one behind each of the rising,
    distinct ``d`` (z nowhere 0, rho > 0): the nearest d of each root, and all
    d_i minus the root, which are exact near it.

    Each step replaces the sums over the poles left and right of a root by one
    pole each with equal value and slope; brackets guard the steps."""
    k = len(d)
    w = rho * z * z
    right = np.append(d[1:], d[-1] + w.sum())
    middle = (d + right) / 2
    at_middle = 1 + (w / (d - middle[:, None])).sum(axis=1)
    near = np.where(at_middle >= 0, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    origin = d[near]
    gaps = d - origin[:, None]
    lo = np.where(at_middle >= 0, d, middle) - origin
    hi = np.where(at_middle >= 0, middle, right) - origin
    left = np.tril(np.ones((k, k)))  # poles at or before the root's own
    pole_l, pole_r = d - origin, right - origin
    t = (lo + hi) / 2
    for _ in range(80):
        away = gaps - t[:, None]
        terms = w / away
        slopes = terms / away
        psi, dpsi = np.einsum("ij,ij->i", terms, left), np.einsum("ij,ij->i", slopes, left)
        f = 1 + terms.sum(axis=1)
        phi, dphi = f - 1 - psi, slopes.sum(axis=1) - dpsi
        bound = 4 * EPS * (1 + phi - psi)
        lo, hi = np.where(f < 0, t, lo), np.where(f > 0, t, hi)
        open_ = (np.abs(f) > bound) & (hi - lo > 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if not open_.any():
            break
        dl, dr = pole_l - t, pole_r - t
        q, s = dpsi * dl * dl, dphi * dr * dr  # psi ~ p + q / (pole - t), phi likewise
        c = f - dpsi * dl - dphi * dr
        # c (dl - x)(dr - x) + q (dr - x) + s (dl - x) = 0 for the step x
        b, e = c * (dl + dr) + q + s, c * dl * dr + q * dr + s * dl
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(b * b - 4 * c * e, 0))
            big = (b + np.copysign(root, b)) / 2
            steps = np.stack([e / big, big / c])
            inside = (t + steps > lo) & (t + steps < hi)
            step = np.where(inside[0], steps[0], np.where(inside[1], steps[1], (lo + hi) / 2 - t))
        new = np.where(open_, t + step, t)
        t = np.where(open_ & (new == t), (lo + hi) / 2, new)
    return near, gaps - t[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of
    vectors diag(values) vectors' + rho v v', rho >= 0."""
    z = vectors.T @ v
    size = np.sqrt(z @ z)
    if not rho * size > 0:
        return values, vectors
    tol = 8 * EPS * max(values[-1], rho * size * size)
    live = rho * np.abs(z) * size > tol
    if not live.any():
        return values, vectors
    kept = np.flatnonzero(live)
    gap = np.diff(values[kept])
    zz = z[kept]
    if len(kept) > 1 and (gap * np.abs(zz[1:] * zz[:-1]) <= 2 * tol * (zz[1:] ** 2 + zz[:-1] ** 2)).any():
        # neighbours that agree are turned until one of them is not touched
        values, vectors, z = values.copy(), vectors.copy(), z.copy()
        i = kept[0]
        for j in kept[1:]:
            tau = np.hypot(z[i], z[j])
            c, s = z[j] / tau, z[i] / tau
            if (values[j] - values[i]) * abs(c * s) <= tol:
                z[i], z[j] = 0.0, tau
                vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
                values[i], values[j] = (values[i] * c * c + values[j] * s * s,
                                        values[i] * s * s + values[j] * c * c)
                live[i] = False
            i = j
        kept = np.flatnonzero(live)
        kept = kept[np.argsort(values[kept], kind="stable")]
    d, z = values[kept], z[kept]
    near, away = secular_roots(d, z, rho)
    roots = d[near] - away[np.arange(len(d)), near]
    # the z for which these roots are exact: products over all roots and poles
    apart = d[:, None] - d
    np.fill_diagonal(apart, rho)
    solved = np.copysign(np.sqrt(np.abs(np.prod(away / apart, axis=0))), z)
    turned = solved[:, None] / away.T
    turned /= np.sqrt((turned * turned).sum(axis=0))
    values = values.copy()
    values[kept] = np.maximum(roots, 0)
    out = vectors.copy()
    out[:, kept] = vectors[:, kept] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], out[:, order]


class Spectrum:
    """Count, sums, mean (from a whole-number origin) and the scatter matrix's
    eigenpairs of some vectors."""

    def __init__(self, origin: np.ndarray):
        k = len(origin)
        self.n, self.origin, self.mean = 0, origin, np.zeros(k)
        self.high, self.low = np.zeros(k, np.int64), np.zeros(k, np.int64)  # sums of x >> 32 and of the rest
        self.values, self.vectors = np.zeros(k), np.eye(k)

    def take(self, x: np.ndarray) -> None:
        self.high += x >> 32
        self.low += x & 0xFFFFFFFF
        apart = (x - self.origin) - self.mean
        self.n += 1
        self.values, self.vectors = rank_one(self.values, self.vectors, (self.n - 1) / self.n, apart)
        self.mean = self.mean + apart / self.n

    def add(self, other: Spectrum) -> None:
        apart = (other.origin - self.origin) + (other.mean - self.mean)
        n = self.n + other.n
        values, vectors = self.values, self.vectors
        for value, vector in zip(other.values, other.vectors.T):
            values, vectors = rank_one(values, vectors, value, vector)
        self.values, self.vectors = rank_one(values, vectors, self.n * (other.n / n), apart)
        self.mean = self.mean + apart * (other.n / n)
        self.n, self.high, self.low = n, self.high + other.high, self.low + other.low

    def row(self, part: int) -> tuple:
        return (part, self.n, self.origin.tolist(), self.mean.tolist(), self.high.tolist(), self.low.tolist(),
                self.values.tolist(), self.vectors.ravel().tolist())

    @staticmethod
    def of(row) -> Spectrum:
        out = Spectrum(np.array(row["origin"], np.int64))
        out.n, out.mean = int(row["n"]), np.array(row["mean"], float)
        out.high, out.low = np.array(row["high"], np.int64), np.array(row["low"], np.int64)
        out.values = np.array(row["values"], float)
        out.vectors = np.array(row["vectors"], float).reshape(len(out.mean), -1)
        return out


@dataclass
class Model:
    """n, sums S (exact), components (columns), their eigenvalues, V's trace
    and the largest entry of the whitened covariance minus the identity."""
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """S / n as whole numbers and what is left of S."""
        return (np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre()
        return ((x - whole) - rest / self.n) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S)^2) of each row, exact."""
        whole, rest = self.centre()
        apart = x - whole
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if most * most * len(whole) < 1 << 63:
            r = self.n * apart - rest
            return (r * r).sum(axis=1).tolist()
        rows = [sum((self.n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in apart.tolist()]
        return [r if r < 1 << 63 else None for r in rows]


def as_whole(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry, null for a vector that is dropped."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.least(F.greatest(
        c.cast("double") * SCALE, F.lit(-EDGE)), F.lit(EDGE))) + F.lit(SHIFT).cast("long"))
    return F.when(usable & (F.size(vector) > 0), whole)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "x") -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Matrices of at most ROWS_AT_ONCE vectors, and the rows they came with."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(i, ROWS_AT_ONCE)
            yield part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part


def combined(spectra: DataFrame) -> DataFrame:
    """FAN_IN spectra at a time become one, until one is left."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        parts = iter(rows.to_dict("records"))
        out = Spectrum.of(next(parts))
        for row in parts:
            out.add(Spectrum.of(row))
        return pd.DataFrame([out.row(int(rows["part"].iloc[0]) // FAN_IN)],
                            columns=[f.split(" ")[0] for f in SPECTRUM.split(", ")])

    while spectra.count() > 1:
        spectra = staged(spectra.groupBy(F.floor(F.col("part") / FAN_IN).cast("long").alias("group"))
                         .applyInPandas(one, SPECTRUM), "spectra")
    return spectra


def summed_squares(vectors: DataFrame, basis) -> np.ndarray:
    """sum(y y') over all vectors, y = basis(x); each task sums its own, and
    the tasks' rows of the matrix are added row by row."""
    def own(batches):
        total = 0
        for x, _ in blocks(batches):
            y = basis(x)
            total = total + y.T @ y
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(list(total))],
                                             names=["row", "entries"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": rows["row"].iloc[:1], "entries": [np.stack(rows["entries"].to_list()).sum(axis=0)]})

    ddl = "row long, entries array<double>"
    found = vectors.select("x").mapInArrow(own, ddl).groupBy("row").applyInPandas(add, ddl).collect()
    return np.array([r["entries"] for r in sorted(found, key=lambda r: r["row"])])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a stored table of distinct vectors (x: array<long>); None
    if it is empty."""
    spark = vectors.sparkSession
    ship(spark)
    lengths = [r[0] for r in vectors.select(F.size("x")).distinct().limit(2).collect()]
    if not lengths:
        return None
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths, {lengths} among them")

    def own(batches):
        spectrum = None
        for x, _ in blocks(batches):
            spectrum = spectrum or Spectrum(x[0])
            for row in x:
                spectrum.take(row)
        if spectrum:
            from pyspark import TaskContext
            row = spectrum.row(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row],
                                             names=[f.split(" ")[0] for f in SPECTRUM.split(", ")])

    got = Spectrum.of(combined(staged(vectors.select("x").mapInArrow(own, SPECTRUM), "spectra")).first())
    basis, _ = np.linalg.qr(got.vectors)
    sums = [(int(h) << 32) + int(r) for h, r in zip(got.high, got.low)]
    model = Model(got.n, sums, basis, np.ones(len(sums)), 0.0)
    v = summed_squares(vectors, model.whiten) / model.n  # the covariance in the basis
    values, turn = np.linalg.eigh((v + v.T) / 2)
    first = np.flatnonzero(values > NO_VARIANCE * max(values[-1], 0))[::-1][:components]
    found = basis @ turn[:, first]
    found /= np.sqrt((found * found).sum(axis=0))
    if len(first):
        found *= np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(first))])
    model = Model(got.n, sums, found, values[first], float(np.trace(v)))
    if len(first):
        own_covariance = summed_squares(vectors, model.whiten) / model.n
        model.identity_error = float(np.abs(own_covariance - np.eye(len(first))).max())
    return model


def transform(rows: DataFrame, model: Model) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of
    each row (vec_id, x) and component."""
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    k = len(model.values)

    def emitted(batches):
        for x, rows in blocks(batches):
            m = len(x) * k
            places = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                rows.column("vec_id").take(places), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(m, model.n)), pa.array(model.deviations(x), pa.int64()).take(places),
                pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.values / model.trace, len(x))),
                pa.array(np.full(m, model.identity_error))], schema=schema)

    return rows.select("vec_id", "x").mapInArrow(
        emitted, "vec_id long, component int, n long, deviation long, whitened double, explained double,"
                 " identity_error double")


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """``transform`` of a table's rows by the model of its distinct vectors."""
    rows = staged(table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                               as_whole(F.col(f"`{vector_col}`")).alias("x")).filter("x is not null"), "whole")
    model = fit(staged(rows.select("x").distinct(), "fit-list"), components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double,"
                                                     " explained double, identity_error double")
    return transform(rows, model)
