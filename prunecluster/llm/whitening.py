"""Whitening of embeddings on their leading components, by Jacobi-Davidson over a covariance that is never formed.

Of the covariance only products with a few vectors are taken: each task adds up c (c . q) over its centred rows c, for
all columns q at once, and one row per task and dimension is summed in Spark. The driver holds a few vectors of
the dimension's length, nothing that grows with the rows.

The eigenvectors come from a subspace. Rayleigh-Ritz on it gives the best vectors so far; leading ones whose residual
has reached rounding are locked and kept out of the rest. For those that are left, the correction equation

    (I - Q Q^T) (V - theta I) (I - Q Q^T) t = -r,    Q the locked and the present vectors,

is solved by a few steps of MINRES, all columns in step, so that a step costs one pass. The corrections enlarge the
subspace, which is cut back to its leading vectors when it has grown. At the end the residuals are taken
once more from a product of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.llm.batches import map_rows
from prunecluster.storage import RunTables

#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors searched for beyond those wanted; columns at which the subspace is cut back, and those that stay.
GUARDS, MOST_COLUMNS, KEPT_COLUMNS = 4, 96, 40
#: Steps of MINRES in a correction, and the part of the residual at which it ends earlier.
INNER_STEPS, INNER_PART = 4, 0.02
#: Residuals, by the largest eigenvalue, that count as rounding; those that a search that no longer moves may end with.
ROUNDING, STALLED, MOST_TURNS = 32 * np.finfo(float).eps, 1e-11, 300
ROWS_AT_ONCE = 4096
SAFE = 1 << 62


@dataclass(frozen=True)
class Whitener:
    """Rows x become (x - sums / rows) @ vectors / sqrt(values)."""

    rows: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray
    products: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def usable(vector: str):
    """Not null, and every entry a finite number."""
    return F.coalesce(
        F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False)
    )


def whole_numbers(embeddings: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, x array<long>) of the rows with a usable vector of that length."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    fit = usable("embedding") & (F.size("embedding") == dimension)
    return embeddings.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def common_length(embeddings: DataFrame) -> int:
    """The length that most usable vectors have, the greater of two; 0 if there are none."""
    sizes = embeddings.where(usable("embedding")).groupBy(F.size("embedding").alias("size")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return first.size if first else 0


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _wide(x: np.ndarray, rows: int) -> np.ndarray:
    """The numbers in a type in which ``rows`` times one, less a sum of them, is exact."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return x if 2 * rows * largest < SAFE else x.astype(object)


def centred(x: np.ndarray, rows: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """rows * x - sums, exact, and the same over rows as doubles."""
    wide = _wide(x, rows)
    exact = wide * rows - np.array(sums, dtype=object if wide.dtype == object else np.int64)
    return exact, exact.astype(np.float64) / rows


def deviations(exact: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null if it is beyond a long."""
    if not exact.size:
        return [0] * len(exact)
    if exact.dtype != object and exact.shape[1] * int(np.abs(exact).max()) ** 2 < SAFE:
        return (exact * exact).sum(axis=1).tolist()
    totals = (exact.astype(object) ** 2).sum(axis=1)
    return [int(t) if t < 1 << 63 else None for t in totals]


def column_sums(numbers: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Rows, and the sum of each dimension in whole numbers of any size."""

    def add(batches):
        rows, total = 0, np.zeros(dimension, dtype=object)
        for batch in batches:
            x = _matrix(batch.column("x"), dimension)
            if len(x):
                rows += len(x)
                total = total + _wide(x, len(x)).sum(axis=0).astype(object)
        if rows:
            yield -1, Decimal(rows)
            for i, s in enumerate(total):
                yield i, Decimal(int(s))

    added = map_rows(numbers.select("x"), add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    found = {r.i: int(r.s) for r in added.collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dimension)]


class CentredRows:
    """The centred rows in blocks, written once to the shared folder; sums over all of them."""

    def __init__(self, numbers: DataFrame, dimension: int, rows: int, sums: list[int], run: RunTables):
        def pack(batches):
            for batch in batches:
                x = _matrix(batch.column("x"), dimension)
                for start in range(0, len(x), ROWS_AT_ONCE):
                    _, c = centred(x[start : start + ROWS_AT_ONCE], rows, sums)
                    yield len(c), c.astype("<f8").tobytes()

        blocks = map_rows(numbers.select("x"), pack, "n int, c binary", weigh=lambda row: len(row[1]))
        self.blocks, self.dimension, self.rows, self.passes = run.write(blocks, "centred"), dimension, rows, 0

    def total(self, of_block, height: int, width: int) -> np.ndarray:
        """Sum over all blocks of ``of_block``, which makes a matrix of so many rows and columns of each."""
        dimension = self.dimension

        def add(batches):
            whole = np.zeros((height, width))
            for batch in batches:
                for data in batch.column("c"):
                    whole += of_block(np.frombuffer(data.as_buffer(), "<f8").reshape(-1, dimension))
            for i, row in enumerate(whole.tolist()):
                yield i, row

        parts = map_rows(self.blocks, add, "i int, v array<double>")
        summed = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(width)])
        whole = np.zeros((height, width))
        for row in summed.collect():
            whole[row[0]] = row[1:]
        self.passes += 1
        return whole

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times the columns of q, in one pass."""
        q = np.ascontiguousarray(q)
        return self.total(lambda c: c.T @ (c @ q), *q.shape) / self.rows


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """A basis of what ``new`` adds to orthonormal columns."""
    known = np.hstack(against) if against else new[:, :0]
    sizes = np.linalg.norm(new, axis=0)
    new = new[:, sizes > 0] / sizes[sizes > 0]
    for _ in range(2):
        new = new - known @ (known.T @ new)
        basis, weight, _ = np.linalg.svd(new, full_matrices=False)
        new = basis[:, weight > 1e-10]
    return new - known @ (known.T @ new)


def minres(operator, right: np.ndarray, steps: int, part: float) -> np.ndarray:
    """Solves ``operator`` x = right for each column by itself; every step applies the operator once to all."""
    x, w, w2 = (np.zeros_like(right) for _ in range(3))
    r1 = r2 = right
    beta = first = np.linalg.norm(right, axis=0)
    oldb, dbar, epsln, cs, sn, phibar = (np.zeros(len(beta)) for _ in range(6))
    cs, phibar = cs - 1, beta.copy()
    floor = np.finfo(float).tiny
    for step in range(steps):
        v = r2 / np.maximum(beta, floor)
        y = operator(v)
        if step:
            y = y - (beta / np.maximum(oldb, floor)) * r1
        alfa = (v * y).sum(axis=0)
        y = y - (alfa / np.maximum(beta, floor)) * r2
        r1, r2, oldb, beta = r2, y, beta, np.linalg.norm(y, axis=0)
        oldeps, delta, gbar = epsln, cs * dbar + sn * alfa, sn * dbar - cs * alfa
        epsln, dbar = sn * beta, -cs * beta
        gamma = np.maximum(np.hypot(gbar, beta), 1e-300)
        cs, sn = gbar / gamma, beta / gamma
        phi, phibar = cs * phibar, sn * phibar
        w1, w2 = w2, w
        w = (v - oldeps * w1 - delta * w2) / gamma
        live = (oldb > 0) & np.isfinite(w).all(axis=0)
        x[:, live] += (phi * w)[:, live]
        if (phibar <= part * first).all():
            break
    return x


def ritz(basis: np.ndarray, image: np.ndarray):
    """Values, falling, with their vectors and what the covariance makes of these."""
    small = basis.T @ image
    values, mix = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], basis @ mix[:, ::-1], image @ mix[:, ::-1]


def leading_vectors(product, dimension: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenvalues, their unit vectors and residuals, of a symmetric ``product`` with no negative ones."""
    wanted = min(wanted, dimension)
    rng = np.random.default_rng(seed)
    nothing = np.zeros((dimension, 0))
    basis = orthonormal(rng.normal(size=(dimension, min(dimension, wanted + GUARDS))))
    image, locked, scale, last, stalled = product(basis), nothing, 0.0, np.inf, 0
    for _ in range(MOST_TURNS):
        values, vectors, images = ritz(basis, image)
        scale = max(scale, values[0] if len(values) else 0.0, np.finfo(float).tiny)
        residuals = images - vectors * values
        residuals = residuals - locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0) / scale
        open_ones = wanted - locked.shape[1]
        worst = sizes[:open_ones].max(initial=0.0)
        stalled = stalled + 1 if worst > last / 2 else 0
        last = min(last, worst)
        enough = STALLED if stalled >= 4 and worst <= STALLED else ROUNDING
        done = int(np.argmax(np.r_[sizes[:open_ones] > enough, True]))
        locked = np.hstack([locked, vectors[:, :done]])
        if locked.shape[1] >= wanted:
            # once more, from a product of the locked vectors alone
            own = orthonormal(locked)
            values, vectors, images = ritz(own, product(own))
            sizes = np.linalg.norm(images - vectors * values, axis=0)
            return values, vectors, sizes
        if done:
            last, stalled = np.inf, 0
        values, vectors, images, residuals = values[done:], vectors[:, done:], images[:, done:], residuals[:, done:]
        if vectors.shape[1] > MOST_COLUMNS:
            values, vectors, images, residuals = (m[..., :KEPT_COLUMNS] for m in (values, vectors, images, residuals))
        basis, image = vectors, images
        active = min(len(values), wanted - locked.shape[1] + GUARDS)
        q = np.hstack([locked, vectors[:, :active]])
        theta = values[:active]

        def project(m):
            return m - q @ (q.T @ m)

        def shifted(m):
            m = project(m)
            return project(product(m) - m * theta)

        new = nothing
        if q.shape[1] < dimension:
            fixed = minres(shifted, project(-residuals[:, :active]), INNER_STEPS, INNER_PART)
            new = orthonormal(project(fixed), locked, basis)
        if not new.shape[1]:
            # nothing left to correct by: a fresh direction, or none if the space is full
            new = orthonormal(rng.normal(size=(dimension, 1)), locked, basis)
        if new.shape[1] and locked.shape[1] + basis.shape[1] + new.shape[1] <= dimension:
            basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
        else:
            image = product(basis)
    raise RuntimeError(f"residuals stay at {last:.1e} of the largest eigenvalue")


def fit_whitening(embeddings: DataFrame, components: int = COMPONENTS, run: RunTables | None = None) -> Whitener | None:
    """The leading components of all usable vectors; None if there are none that differ."""
    run = run or RunTables(embeddings.sparkSession)
    dimension = common_length(embeddings)
    if not dimension:
        return None
    numbers = whole_numbers(embeddings, dimension)
    rows, sums = column_sums(numbers, dimension)
    if rows < 2:
        return None
    centre = CentredRows(numbers, dimension, rows, sums, run)
    trace = float(centre.total(lambda c: np.array([[(c * c).sum()]]), 1, 1)[0, 0]) / rows
    if not trace > 0:
        return None
    values, vectors, residuals = leading_vectors(centre.product, dimension, components)
    real = values > dimension * ROUNDING * values[0]  # others are zero but for rounding
    values, vectors, residuals = values[real], vectors[:, real], residuals[real]
    across = vectors / np.sqrt(values)

    def moments(c):
        z = c @ across
        return np.vstack([z.T @ z, z.sum(axis=0)])

    found = centre.total(moments, len(values) + 1, len(values)) / rows
    error = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(len(values))).max())
    return Whitener(rows, sums, values, vectors, trace, error, residuals, centre.passes)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null or hold a null, a NaN or an infinite entry are left out, as are those whose length is not that of
    most (the greater length of two as frequent). Components are numbered from 1 by falling eigenvalue; those whose
    eigenvalue is zero but for rounding have no rows, so equal vectors, a single one or an empty table give
    none. Rows that repeat, or without id, count and are answered one by one. Equal eigenvalues have some
    orthonormal basis of their space. A deviation beyond a long is null. Other columns are not read.
    """
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    run = RunTables(spark)
    fit = fit_whitening(embeddings, components, run)
    run.drop("centred")
    if fit is None:
        return spark.createDataFrame([], ddl)
    dimension, count = fit.vectors.shape
    rows, sums, error = fit.rows, fit.sums, fit.identity_error
    across, explained = fit.vectors / np.sqrt(fit.values), fit.explained

    def answer(batches):
        for batch in batches:
            ids, x = batch.column("vec_id"), _matrix(batch.column("x"), dimension)
            for start in range(0, len(x), ROWS_AT_ONCE):
                exact, c = centred(x[start : start + ROWS_AT_ONCE], rows, sums)
                n = len(c)
                place = pa.array(np.repeat(np.arange(n), count))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(start, n).take(place), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * count, rows)), pa.array(deviations(exact), pa.int64()).take(place),
                    pa.array((c @ across).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * count, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole_numbers(embeddings, dimension).mapInArrow(answer, ddl)
