"""Whitening of embeddings by an incremental eigendecomposition.

Each task keeps the eigenpairs of the scatter of the vectors it has met. A vector changes the scatter by a rank-one term
about the running mean; its eigenvalues are the roots of a secular equation, after components that the vector doesn't touch
and equal eigenvalues are deflated. Spectra are combined by the same step, the eigenpairs of one after those of the other and
the difference of the means, in rounds of a bounded number. A Rayleigh-Ritz step over all vectors, in the basis found, ends
it: tasks sum products of projections, and a small matrix gives the eigenpairs to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import materialise

#: Steps in a unit, and what is added so that no value is negative.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Vectors of a task, about; spectra or sums combined at once.
ROWS, FAN = 20_000, 16
EPS = np.finfo(float).eps
#: Entries beyond it don't become exact whole numbers; such a vector counts as one with an entry that isn't finite.
LARGEST = 2.0**46

SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def secular_roots(d: np.ndarray, zz: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(roots, gaps) of 1 + rho * sum of zz / (d - x): d rises strictly, zz is positive and sums to 1.

    A root lies above each d and below the next; ``gaps[j, i]`` is d[j] less root i, exact in the digits that matter, as
    each root is found as its distance from the nearer of the two. All roots are improved at once, by rational functions
    with the two poles beside them; a step that leaves a root's bracket halves it.
    """
    k = len(d)
    upper = np.append(d[1:], d[-1] + rho)
    width = upper - d
    middle = d + width / 2
    left = 1 + rho * (zz[:, None] / (d[:, None] - middle)).sum(axis=0) >= 0
    left[-1] = True
    origin = np.where(left, d, upper)
    low, high = np.where(left, 0.0, -width / 2), np.where(left, width / 2, 0.0)
    if rho * (zz / (d - middle[-1])).sum() + 1 < 0:
        low[-1], high[-1] = width[-1] / 2, width[-1]
    else:
        high[-1] = width[-1] / 2
    base = d[:, None] - origin
    tau = (low + high) / 2
    below = np.tri(k, dtype=bool).T  # [j, i]: pole j is at or below root i
    at, last = np.arange(k), k - 1
    for _ in range(60):
        gap = base - tau
        terms = rho * zz[:, None] / gap
        slopes = terms / gap
        psi, psi_slope = np.where(below, terms, 0).sum(axis=0), np.where(below, slopes, 0).sum(axis=0)
        phi, phi_slope = np.where(below, 0, terms).sum(axis=0), np.where(below, 0, slopes).sum(axis=0)
        f = 1 + psi + phi
        done = np.abs(f) <= EPS * k * (1 + phi - psi)
        if done.all():
            break
        rising = f < 0  # f rises from the pole below to the one above
        low, high = np.where(rising, tau, low), np.where(rising, high, tau)
        a, b = gap[at, at], gap[np.minimum(at + 1, last), at]
        q, s = psi_slope * a * a, phi_slope * b * b
        c = 1 + psi - psi_slope * a + phi - phi_slope * b
        first, second = c * (a + b) + q + s, c * a * b + q * b + s * a
        root = np.sqrt(np.maximum(0, first * first - 4 * second * c))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(first <= 0, (first - root) / (2 * c), 2 * second / (first + root))
            step[last] = a[last] + q[last] / (1 + psi[last] - psi_slope[last] * a[last])
        new = tau + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        new = np.where(done, tau, new)
        if (new == tau).all():
            break
        tau = new
    return origin + tau, base - tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The eigenpairs, values rising, of a matrix with the given ones plus ``weight`` v v^T; weight isn't negative."""
    z = vectors.T @ v
    norm = float(z @ z)
    rho = weight * norm
    tol = 8 * EPS * max(float(values[-1]), rho)
    if rho <= tol:
        return values, vectors
    z = z / np.sqrt(norm)
    values = values.copy()
    live = np.nonzero(rho * np.abs(z) > tol)[0]
    d, t = values[live], z[live]
    size = np.hypot(t[:-1], t[1:])
    if len(live) > 1 and (np.abs(np.diff(d) * t[:-1] * t[1:]) <= tol * size * size).any():
        vectors, keep, last = vectors.copy(), [], live[0]
        for i in live[1:]:  # two equal values: turn the plane of their vectors until the first is left alone
            r = np.hypot(z[last], z[i])
            cos, sin = z[i] / r, z[last] / r
            if abs((values[i] - values[last]) * cos * sin) <= tol:
                z[i], z[last] = r, 0.0
                vectors[:, [last, i]] = vectors[:, [last, i]] @ np.array([[cos, sin], [-sin, cos]])
                low, high = values[last], values[i]
                values[last], values[i] = low * cos * cos + high * sin * sin, low * sin * sin + high * cos * cos
            else:
                keep.append(last)
            last = i
        live = np.array([*keep, last])
        rising = np.argsort(values[live], kind="stable")
        live = live[rising]
        d, t = values[live], z[live]
    share = t * t
    share = share / share.sum()
    rho = rho * float(t @ t)
    roots, gaps = secular_roots(d, share, rho)
    k = len(d)
    # the vector for which these roots are exact, so that the new vectors are orthogonal
    at_or_above = np.tri(k, dtype=bool).T
    against = np.where(at_or_above, np.append(d[1:], 0)[None, :] - d[:, None], d[None, :] - d[:, None])
    against[:, k - 1] = 1.0
    exact = np.sqrt(np.abs(np.prod(-gaps / against, axis=1))) * np.where(t < 0, -1, 1)
    turned = exact[:, None] / gaps
    turned /= np.sqrt((turned * turned).sum(axis=0))
    if len(live) == len(values):
        return roots, vectors[:, live] @ turned
    values[live] = roots
    vectors = vectors.copy()
    vectors[:, live] = vectors[:, live] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean and the scatter's eigenpairs, values rising, of some vectors."""

    def __init__(self, size: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(size), np.zeros(size), np.eye(size)

    def add(self, v: np.ndarray) -> None:
        """One more vector: a rank-one term about the mean so far."""
        apart = v - self.mean
        self.n += 1
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, (self.n - 1) / self.n)
        self.mean = self.mean + apart / self.n

    def join(self, other: Spectrum) -> None:
        """The vectors of another one too: its eigenpairs and the difference of the means, a rank-one term each."""
        if other.n:
            apart, n = other.mean - self.mean, self.n + other.n
            for value, vector in zip(other.values, other.vectors.T, strict=True):
                if value > 0:
                    self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * other.n / n)
            self.mean, self.n = self.mean + apart * (other.n / n), n

    def packed(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, size: int) -> Spectrum:
        x, out = np.frombuffer(raw), cls(size)
        out.n, out.mean, out.values, out.vectors = int(x[0]), x[1 : size + 1], x[size + 1 : 2 * size + 1], x[2 * size + 1 :].reshape(size, size)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _joined(parts: DataFrame, tasks: int, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """The one value that ``merge`` makes of the parts (id, value), at most ``FAN`` at once, in rounds on the executors."""

    def function(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [int(group["id"].iloc[0]) // FAN], "value": [merge(list(group.sort_values("id")["value"]))]})

    while tasks > 1:
        parts = parts.groupBy(F.floor(F.col("id") / FAN)).applyInPandas(function, "id long, value binary")
        tasks = -(-tasks // FAN)
    row = parts.select("value").first()
    return bytes(row[0]) if row else None


def _by_task(fit: DataFrame, function: Callable[[Iterator[np.ndarray]], bytes | None]) -> DataFrame:
    """(id, value): what a function makes of each task's vectors, which come in matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        value = function(_matrix(b.column("x")) for b in batches if len(b))
        if value is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([value], pa.binary())], names=["id", "value"])

    return fit.mapInArrow(run, "id long, value binary")


def _summed(fit: DataFrame, function: Callable[[np.ndarray], np.ndarray], kind: type = float) -> np.ndarray:
    """The sum of a function of the vectors' matrices."""

    def task(matrices: Iterator[np.ndarray]) -> bytes | None:
        total = None
        for x in matrices:
            total = function(x) if total is None else total + function(x)
        return None if total is None else total.tobytes()

    raw = _joined(_by_task(fit, task), fit.rdd.getNumPartitions(), lambda parts: np.sum([np.frombuffer(p, kind) for p in parts], axis=0).tobytes())
    return np.frombuffer(raw, kind)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.append(x.sum(axis=0), len(x))


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows with ``x``, their vectors as whole numbers, in place of the column.

    Rows go whose vector is null, empty, or has an entry that is null or not finite (or beyond ``LARGEST``).
    """
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    sound = vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(~bad)
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return sound.withColumn(column, x).withColumnRenamed(column, "x")


def commonest_size(rows: DataFrame) -> tuple[int, int]:
    """(entries, rows) of the commonest number of entries of ``x``, of equally common ones the largest."""
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    top = sizes.agg(F.max(F.struct("n", "size")).alias("x")).first()[0]
    return (top["size"], top["n"]) if top else (0, 0)


def distinct_vectors(rows: DataFrame, n: int) -> DataFrame:
    """(x) each vector of n rows once, written and dealt to tasks of about ``ROWS``."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))
    return materialise(rows.select("x").distinct().repartition(tasks, "x"))


def fitted(fit: DataFrame, size: int, components: int = COMPONENTS) -> dict | None:
    """The whitening of distinct vectors (x) of a size: n, sums, centre, components (as columns), values, explained and identity_error.

    Components with an eigenvalue that rounding alone may have made have no place in it. Without two different vectors
    there is none.
    """
    *sums, n = (int(v) for v in _summed(fit, _sums, np.int64))
    centre = np.array([s // n for s in sums])
    rest = np.array([(s % n) / n for s in sums])

    def spectrum(matrices: Iterator[np.ndarray]) -> bytes:
        found = Spectrum(size)
        for x in matrices:
            for v in (x - centre) - rest:
                found.add(v)
        return found.packed()

    def combined(parts: list[bytes]) -> bytes:
        found, *others = (Spectrum.unpacked(p, size) for p in parts)
        for other in others:
            found.join(other)
        return found.packed()

    rough = Spectrum.unpacked(_joined(_by_task(fit, spectrum), fit.rdd.getNumPartitions(), combined), size)
    basis = np.linalg.qr(rough.vectors[:, ::-1])[0]

    def products(x: np.ndarray) -> np.ndarray:
        z = ((x - centre) - rest) @ basis
        return z.T @ z

    ritz = _summed(fit, products).reshape(size, size) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    trace = float(np.trace(ritz))
    k = int((values[:components] > 100 * size * EPS * max(values[0], 0)).sum()) if n > 1 else 0
    if not k:
        return None
    values, vectors = values[:k], vectors[:, :k]
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    scaled = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = ((x - centre) - rest) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums_of = _summed(fit, moments).reshape(k + 1, k) / n
    error = float(np.abs(sums_of[:-1] - np.outer(sums_of[-1], sums_of[-1]) - np.eye(k)).max())
    return {"n": n, "sums": sums, "centre": centre, "rest": rest, "components": vectors, "scaled": scaled, "values": values, "explained": values / trace, "identity_error": error}


def deviations(x: np.ndarray, model: dict) -> list[int | None]:
    """The sums of (n x - S)^2, exact; null where it is no 64-bit number."""
    n, centre = model["n"], model["centre"]
    rest = np.array([s - n * int(c) for s, c in zip(model["sums"], centre, strict=True)])
    y = x - centre
    most = n * int(np.abs(y).max(initial=0)) + int(np.abs(rest).max())
    if most * most * x.shape[1] < 2**63:
        return ((n * y - rest) ** 2).sum(axis=1).tolist()
    exact = (sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in y)
    return [d if d < 2**63 else None for d in exact]


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, SCHEMA): a row for each vector that stays and each component, whitened over the distinct vectors.

    Vectors that ``whole_numbers`` leaves out, or of another than the commonest size, have no rows. Repeated rows, ids and
    vectors each have their own rows, a null vec_id too, while the fit counts a vector once; equal eigenvalues keep some
    fixed order. Fewer components are given where the vectors have fewer entries or vary in fewer directions; with fewer
    than two different vectors, or an empty table, there are no rows. Other columns don't matter. The model, whose size is
    the square of a vector's, is all that passes through the driver.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = whole_numbers(vectors.select("vec_id", column), column)
    size, n = commonest_size(rows)
    rows = rows.filter(F.size("x") == size)
    model = fitted(distinct_vectors(rows, n), size, components) if n else None
    if model is None:
        return spark.createDataFrame([], f"vec_id {kind}, {SCHEMA}")
    centre, rest, scaled, explained = model["centre"], model["rest"], model["scaled"], model["explained"]

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                b = whole.slice(at, 2000)
                x, k = _matrix(b.column("x")), scaled.shape[1]
                white = ((x - centre) - rest) @ scaled
                ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(len(b)), k)))
                off = pa.array(deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(b)), k)))
                each = lambda v, t: pa.array(np.tile(v, len(b)), t)
                constant = lambda v, t: pa.array(np.full(len(b) * k, v), t)
                yield pa.RecordBatch.from_arrays(
                    [ids, each(np.arange(1, k + 1), pa.int32()), constant(model["n"], pa.int64()), off, pa.array(white.ravel()), each(explained, pa.float64()), constant(model["identity_error"], pa.float64())],
                    names=["vec_id", *(c.split()[0] for c in SCHEMA.split(", "))],
                )

    return rows.mapInArrow(function, f"vec_id {kind}, {SCHEMA}")
