"""Whitening of embeddings by a spectral divide and conquer of their covariance.

The covariance is exact: components are whole numbers, taken relative to the whole
number nearest to their mean, so that all sums are whole, and what is left of the
means is taken off before anything is rounded. The covariance is then split by
spectral projectors. The polar factor of ``A - s I`` by the QR-based dynamically
weighted Halley iteration (QDWH) has eigenvalues 1 and -1 for those of ``A`` above
and below ``s``; half its sum with the identity projects onto the upper ones. Bases
of both invariant subspaces give two smaller matrices, and so on down to single
components. Only the matrix of the size of the dimensions is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiresift.llm.vectors import matrix, usable, whole

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Rows of one product in a task; with digits of 21 bits its sums are exact.
CHUNK = 4096
_DIGIT = 21
#: Size of a scaled component from which on a row takes no part.
MOST = 2.0 ** 50
#: Components with less than this share of the largest eigenvalue count as constant.
CONSTANT = 1e-12
_EPS = np.finfo(float).eps


# Splitting a symmetric matrix.

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH."""
    n = len(a)
    top = np.linalg.norm(a)
    if top == 0:
        return np.eye(n)
    x = a / top
    try:
        low = 0.9 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(1.0, max(low, _EPS / 4)) if np.isfinite(low) else _EPS / 4
    for _ in range(30):
        # The best weights for singular values in [low, 1].
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square)) if square < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
            step = (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            lower = np.linalg.cholesky(np.eye(n) + wc * x.T @ x)
            step = (wa - wb / wc) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = wb / wc * x + step
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved <= np.cbrt(4 * _EPS) and 1 - low < 1e-10:
            break
    return x


def _halves(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces; None if all eigenvalues are as good as equal."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    if np.linalg.norm(a - diagonal.mean() * np.eye(n)) <= 4 * _EPS * size:
        return None
    draw = np.random.default_rng(n)
    # The mean always lies between two eigenvalues; the median parts them evenly.
    shifts = [np.median(diagonal), diagonal.mean(), *draw.uniform(diagonal[0], diagonal[-1], 20)]
    best = None
    for shift in shifts:
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        upper, _ = np.linalg.qr(projector @ draw.standard_normal((n, rank)))
        upper, _ = np.linalg.qr(projector @ upper)
        q, _ = np.linalg.qr(upper, mode="complete")
        left = np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank])
        if best is None or left < best[0]:
            best = left, q[:, :rank], q[:, rank:]
        if left <= 8 * n * _EPS * size:
            break
    # Shifts that all meet an eigenvalue leave a cluster as narrow as what remains off the diagonal.
    return best and best[1:]


def components_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a = (a + a.T) / 2
    n, size = len(a), float(np.linalg.norm(a))
    vectors: list[np.ndarray] = []
    todo = [np.eye(n)] if n else []
    while todo:
        basis = todo.pop()
        inner = basis.T @ a @ basis
        halves = _halves((inner + inner.T) / 2, size) if basis.shape[1] > 1 else None
        if halves is None:
            vectors.append(basis)
        else:
            todo += [basis @ half for half in halves]
    q = np.hstack(vectors) if vectors else np.eye(n)
    values = np.einsum("ij,ij->j", q, a @ q)
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order]


# Exact sums.

def _digits(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as float64 digits of 21 bits, lowest first."""
    out, half = [], 1 << (_DIGIT - 1)
    while True:
        low = ((y + half) & ((1 << _DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> _DIGIT
        if not y.any():
            return out


def products(y: np.ndarray) -> list[list[int]]:
    """``y.T @ y`` in whole numbers of any size."""
    digits = _digits(y)
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), CHUNK):
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                part = (a[at:at + CHUNK].T @ b[at:at + CHUNK]).astype(np.int64).astype(object)
                total += part * (1 << _DIGIT * (i + j))
    return total.tolist()


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together into tables of at most ``rows`` rows and about that many."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if size and size + part.num_rows > rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if size:
        yield pa.Table.from_batches(held)


class Whitener:
    """What a fit has found: means, components and their weights."""

    def __init__(self, n: int, sums: list[int], pivot: list[int], covariance: np.ndarray, components: int) -> None:
        self.n, self.sums, self.pivot = n, sums, np.array(pivot, np.int64)
        #: Sums relative to the pivot, and the means relative to it, which are at most a half.
        self.rest = [s - n * p for s, p in zip(sums, pivot, strict=True)]
        self.mean = np.array([r / n for r in self.rest])
        values, vectors = components_of(covariance)
        trace = float(np.trace(covariance))
        k = int((values[:components] > CONSTANT * max(trace, 0.0)).sum())
        self.values, self.vectors = values[:k], vectors[:, :k]
        self.explained = self.values / trace if trace > 0 else self.values
        self.weights = self.vectors / np.sqrt(self.values)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.pivot).astype(np.float64) - self.mean) @ self.weights

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) squared, whole, of each row."""
        y = x - self.pivot
        most = int(np.abs(y).max(initial=0)), max(map(abs, self.rest), default=0)
        if max(most) ** 2 * max(1, y.shape[1]) < 1 << 62:
            squares, along = (y * y).sum(axis=1).tolist(), (y @ np.array(self.rest, np.int64)).tolist()
        else:
            wide = y.astype(object)
            squares, along = (wide * wide).sum(axis=1).tolist(), (wide @ np.array(self.rest, object)).tolist()
        n, own = self.n, sum(r * r for r in self.rest)
        return [n * n * a - 2 * n * b + own for a, b in zip(squares, along, strict=True)]


def numbers(rows: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x) of the rows that take part; ``x`` are whole components."""
    x = F.transform(whole("embedding", scale), lambda c: c + F.lit(offset))
    return rows.where(usable("embedding", MOST / scale)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def fit(named: DataFrame, components: int = COMPONENTS, offset: int = OFFSET) -> Whitener | None:
    """The components of ``named`` (vec_id, x); None without rows. Shorter vectors end in ``offset``."""
    n, dims = named.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n:
        return None

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, CHUNK):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims, dtype=np.int32)), pa.array(matrix(part.column("x"), dims, offset).sum(axis=0))],
                names=["i", "s"])

    found = named.select("x").mapInArrow(add_up, "i int, s long").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    sums = [0] * dims
    for row in found:
        sums[row.i] = int(row.s)
    pivot = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(pivot, np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in _chunks(batches, CHUNK):
            more = np.array(products(matrix(part.column("x"), dims, offset) - centre), object)
            total = more if total is None else total + more
        if total is not None:
            for i in range(dims):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(dims, i, np.int32)), pa.array(np.arange(dims, dtype=np.int32)),
                     pa.array([str(v) for v in total[i]])], names=["i", "j", "s"])

    sent = named.select("x").mapInArrow(multiply, "i int, j int, s string").groupBy("i", "j").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rest = [s - n * p for s, p in zip(sums, pivot, strict=True)]
    covariance = np.zeros((dims, dims))
    for row in sent.toLocalIterator():  # a row for each two dimensions
        # Of whole numbers, Python's quotient is the nearest double.
        covariance[row.i, row.j] = (n * int(row.s) - rest[row.i] * rest[row.j]) / (n * n)
    return Whitener(n, sums, pivot, covariance, components)


def identity_error(named: DataFrame, found: Whitener, offset: int = OFFSET) -> float:
    """The largest absolute entry of the covariance of what ``found`` makes of ``named``, minus the identity."""
    dims, k = len(found.pivot), found.weights.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first row sums up the values, whose mean is zero up to rounding; the others their products.
        total = np.zeros((k + 1, k))
        for part in _chunks(batches, CHUNK):
            z = found.whitened(matrix(part.column("x"), dims, offset))
            total += np.vstack([z.sum(axis=0), z.T @ z])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k + 1, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), k + 1)),
             pa.array(total.ravel())], names=["i", "j", "s"])

    total = np.zeros((k + 1, k))
    for row in named.select("x").mapInArrow(multiply, "i int, j int, s double").groupBy("i", "j").agg(
            F.sum("s").alias("s")).collect():  # a row for each two components
        total[row.i, row.j] = row.s
    mean = total[0] / found.n
    return float(np.abs(total[1:] / found.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``rows`` (vec_id, embedding).

    Components of vectors become whole numbers, floor(scale * c) + offset. The fit is
    over all rows that take part, and each of them gives one row for each of the
    first ``components`` components, by falling eigenvalue. Rows take no part if the
    vector is null or has an entry that is null, NaN, infinite, or 2**50 / scale or
    more in size, beyond which the exact sums do not reach. A shorter vector counts as
    ending in zeros. Repeated rows and ids count each; rows without an id have a null
    one. Components that are constant (less than ``CONSTANT`` of the trace) cannot be
    brought to unit variance and give no rows; so one row alone, or equal rows, give
    none. ``deviation`` is null where it exceeds a long. An empty table gives no rows.
    """
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    named = numbers(rows, scale, offset)
    found = fit(named, components, offset)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, dims, k = identity_error(named, found, offset), len(found.pivot), len(found.values)
    names = [f.split()[0] for f in schema.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, CHUNK):
            x = matrix(part.column("x"), dims, offset)
            size = len(x) * k
            every = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array([d if d < 1 << 63 else None for d in found.deviations(x)], pa.int64())
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").combine_chunks().take(every),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, found.n, np.int64)), deviation.take(every),
                pa.array(found.whitened(x).ravel()), pa.array(np.tile(found.explained, len(x))),
                pa.array(np.full(size, error))], names=names)

    return named.mapInArrow(apply, schema)
