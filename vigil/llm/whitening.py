"""Whitening of embeddings with principal components from spectral divide-and-conquer.

The covariance is summed in tasks over each distinct vector once, exactly centred.  Its eigenvectors come from polar
decompositions: of the covariance less a shift, the unitary polar factor (QR-based dynamically weighted Halley
iterations, QDWH) is the matrix sign, whose positive half projects on the invariant subspace of all eigenvalues above
the shift.  An orthonormal basis of each half gives two smaller symmetric matrices, which are split again until they are
scalar; halves beyond the wanted components are not split.  Mean and scaled components, a few numbers for each
dimension, are then sent to all tasks, which project their rows.

Vectors are read on a grid: a component c is the whole number floor(64 * c), so that sums are exact in any order.

Edge cases: rows whose vector is null, empty, or holds null or non-finite components take no part; of vectors of several
lengths those of the most frequent length take part (ties: the shortest).  Repeated vectors count once in the fit, but
each row is projected; a row without an id gives rows without one.  Directions without variance can't be whitened and
give no rows, so a table of equal vectors, or none, gives no rows.  Columns beside vec_id and embedding are not read.
Sums that don't fit a 64-bit number raise an OverflowError before any row is projected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import stored

GRID = 64
EPS = float(np.finfo(float).eps)
#: Rows that one task holds at a time.
AT_ONCE = 8192


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix by QDWH iterations; singular directions become 0."""
    n = len(a)
    # both norms bound the largest singular value from above
    x = a / min(np.linalg.norm(a), np.abs(a).sum(0).max())
    least = EPS / n  # a lower bound of the smallest one that counts; rounding hides smaller ones
    one = np.eye(n)
    for _ in range(60):
        square = least * least
        g = (4 * (1 - square) / square**2) ** (1 / 3) if least < 1 else 0.0
        root = np.sqrt(1 + g)
        h = root + np.sqrt(8 - 4 * g + 8 * (2 - square) / (square * root)) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q = np.linalg.qr(np.concatenate((np.sqrt(c) * x, one)))[0]
        new = b / c * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        least = min(1.0, least * (h + b * square) / (1 + c * square))
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - least < 10 * EPS and moved < 1e-8 * np.sqrt(n):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift within the spectrum; None if a is scalar."""
    n = len(a)
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n))
    if n == 1 or spread <= 8 * EPS * np.linalg.norm(a):
        return None
    # the median halves the spectrum; the mean is always strictly inside it; other quantiles where a shift is an eigenvalue
    diagonal = np.diag(a)
    shifts = [np.median(diagonal), np.trace(a) / n]
    shifts += [np.trace(a) / n + f * spread / n for f in (0.31, -0.31, 0.07, -0.07, 0.013, -0.013)]
    for shift in shifts:
        above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = np.trace(above)
        size = int(round(rank))
        if not 0 < size < n or abs(rank - size) > 1e-6 * n or np.linalg.norm(above @ above - above) > 1e-6 * n:
            continue
        return basis_of(above, size), basis_of(np.eye(n) - above, n - size)
    return None


def basis_of(projector: np.ndarray, size: int) -> np.ndarray:
    """An orthonormal basis of a projector's range: the image of seeded random vectors, projected once more."""
    start = np.random.default_rng(size).normal(size=(len(projector), size))
    return np.linalg.qr(projector @ np.linalg.qr(projector @ start)[0])[0]


def eigenvectors(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, of a symmetric matrix, and their unit vectors as columns."""
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    found: list[np.ndarray] = []
    todo = [np.eye(n)]
    while todo and sum(f.shape[1] for f in found) < wanted:
        basis = todo.pop()
        inner = basis.T @ a @ basis
        halves = split((inner + inner.T) / 2)
        if halves is None:
            found.append(basis)
        else:
            todo += [basis @ halves[1], basis @ halves[0]]  # the upper half is taken next
    vectors = np.concatenate(found, 1)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """Mean times n (on the grid), components as columns, their eigenvalues, and what was measured over the fit list."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def projected(self, grid: np.ndarray) -> np.ndarray:
        centred = (self.n * grid - self.sums) / self.n
        return centred @ self.components / np.sqrt(self.values)


def grids(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, grid): usable vectors on the grid, as the bytes of 64-bit numbers; stored."""

    def run(batches):
        for batch in batches:
            names, vectors = batch.column("vec_id"), batch.column("embedding")
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)  # null becomes nan
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            good = np.flatnonzero((lengths > 0) & (bad[ends] == bad[ends - lengths]))
            cells = np.floor(GRID * np.where(np.isfinite(values), values, 0))
            if len(cells) and np.abs(cells).max() >= 2.0**62:
                raise OverflowError("a component is too large for the grid")
            cells = cells.astype(np.int64)
            out = [cells[ends[i] - lengths[i] : ends[i]].tobytes() for i in good]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(good)), pa.array(lengths[good].astype(np.int32)), pa.array(out, pa.binary())],
                ["vec_id", "size", "grid"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    every = stored(rows.mapInArrow(run, "vec_id long, size int, grid binary"), "grids")
    sizes = every.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    return every.where(F.col("size") == (sizes["size"] if sizes else 0))


def matrices(batches, size: int):
    """The grid rows of Arrow batches as integer matrices."""
    for batch in batches:
        column = batch.column("grid").to_pylist()
        for at in range(0, len(column), AT_ONCE):
            part = column[at : at + AT_ONCE]
            yield np.frombuffer(b"".join(part), np.int64).reshape(len(part), size)


def moments(fit: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, exact sums, least and largest value of each dimension."""

    def run(batches):
        n, total = 0, np.zeros(size, object)
        low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        for rows in matrices(batches, size):
            n += len(rows)
            total += rows.astype(object).sum(0) if np.abs(rows).max() >= 1 << 40 else rows.sum(0).astype(object)
            low, high = np.minimum(low, rows.min(0)), np.maximum(high, rows.max(0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)), pa.array([str(t) for t in total]),
                 pa.array(low), pa.array(high)], ["d", "n", "s", "low", "high"])

    parts = fit.mapInArrow(run, "d int, n long, s string, low long, high long")
    rows = parts.groupBy("d").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"),
    ).orderBy("d").collect()
    if not rows:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = [int(r["s"]) for r in rows]
    low, high = [r["low"] for r in rows], [r["high"] for r in rows]
    n = rows[0]["n"]
    # n * x - S has to fit, and the sum of its squares too
    reach = sum(max(n * h - s, s - n * l) ** 2 for s, l, h in zip(sums, low, high))
    if reach >= 1 << 63:
        raise OverflowError(f"the deviations of {n} vectors may not fit 64 bits")
    return n, np.array(sums, np.int64), np.array(low), np.array(high)


def second_moment(fit: DataFrame, width: int, size: int, centred) -> np.ndarray:
    """The sum over the rows of the products of all pairs of columns of `centred(rows)`."""

    def run(batches):
        total = np.zeros((width, width))
        for rows in matrices(batches, size):
            part = centred(rows)
            total += part.T @ part
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    rows = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    whole = np.zeros((width, width))
    for r in rows:
        whole[r["i"], r["j"]] = whole[r["j"], r["i"]] = r["v"]
    return whole


def fit(rows: DataFrame, wanted: int = 16) -> Whitening | None:
    """Learn from the distinct vectors of `grids`; None without any variance."""
    first = rows.select("size").first()
    if first is None:
        return None
    size = first["size"]
    distinct = stored(rows.select("grid").distinct(), "distinct-vectors")
    n, sums, *_ = moments(distinct, size)
    covariance = second_moment(distinct, size, size, lambda x: (n * x - sums) / n) / n
    values, vectors = eigenvectors(covariance, wanted)
    trace = float(np.trace(covariance))
    real = values > trace * size * EPS * 16
    if not real.any():
        return None
    model = Whitening(n, sums, vectors[:, real], values[real], trace, 0.0)
    width = int(real.sum())
    mean = column_sums(distinct, width, size, model) / n
    error = np.abs(second_moment(distinct, width, size, lambda x: model.projected(x) - mean) / n - np.eye(width)).max()
    return Whitening(n, sums, vectors[:, real], values[real], trace, float(error))


def column_sums(fit: DataFrame, width: int, size: int, model: Whitening) -> np.ndarray:
    """The sums of the whitened columns, 0 but for rounding."""

    def run(batches):
        total = np.zeros(width)
        for rows in matrices(batches, size):
            total += model.projected(rows).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["i", "v"])

    rows = fit.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


def whitened(vectors: DataFrame, wanted: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = grids(vectors)
    model = fit(rows, wanted)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size, width = len(model.sums), len(model.values)
    explained = model.values / model.trace

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                grid = next(matrices([part], size))
                deviation = ((model.n * grid - model.sums) ** 2).sum(1)
                count = len(grid)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(count), width))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * width, model.n)), pa.array(np.repeat(deviation, width)),
                    pa.array(model.projected(grid).ravel()), pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * width, model.identity_error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "grid").mapInArrow(run, schema)
