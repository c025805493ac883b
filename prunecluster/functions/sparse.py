"""Sparse points: struct(size, indices, values) in place of an array of all coordinates.

The nearest centre comes from the entries that are there: |x|^2 - 2 x.c + |c|^2, where x.c is summed over the matches of
a point's entries with the columns of the centres. No array of ``size`` numbers is made, of points or
of centres, in the plan or in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, unwrap_udt

from .centers import Centers
from .distance import check_measure

SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"
#: Products of entries, and cells of a block of distances, that are worked on at once.
MATCHES, CELLS = 1 << 21, 1 << 21


def sparse_point(vector: Column) -> Column:
    """A sparse point from an ML vector; a dense one has an entry for each coordinate."""
    v = unwrap_udt(vector)
    every = F.transform(v["values"], lambda _, i: i)
    return F.struct(
        F.coalesce(v["size"], F.size(v["values"])).alias("size"), F.coalesce(v["indices"], every).alias("indices"), v["values"].alias("values")
    )


def is_sparse(df: DataFrame, column: str = "x") -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, T.StructType) and kind.names == ["size", "indices", "values"]


@F.udf(VectorUDT())
def ml_vector(x):
    """The ML vector of a sparse point, for samples that go to Spark's own KMeans."""
    return SparseVector(x.size, x.indices, x["values"])


@dataclass(frozen=True)
class SparseCenters:
    """Centres by their entries: those of row i lie at ``starts[i]:starts[i + 1]``. Rows in ascending order of ``ids``."""

    dims: int
    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    ids: list = field(default_factory=list)
    weights: np.ndarray | None = None

    def __post_init__(self):
        if not self.ids:
            object.__setattr__(self, "ids", list(range(len(self))))

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def nbytes(self) -> int:
        names = sum(map(len, self.ids)) if self.id_type == "string" else 4 * len(self)
        return self.starts.nbytes + self.indices.nbytes + self.values.nbytes + names

    @property
    def id_type(self) -> str:
        return "string" if self.ids and isinstance(self.ids[0], str) else "int"

    def with_weights(self, weights) -> "SparseCenters":
        return SparseCenters(self.dims, self.starts, self.indices, self.values, self.ids, np.asarray(weights, float))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """(center_id, c, weight), c a sparse point, weight null where not known."""
        weights = [None] * len(self) if self.weights is None else [float(w) for w in self.weights]
        rows = [
            (i, (self.dims, self.indices[a:b].tolist(), self.values[a:b].tolist()), w)
            for i, a, b, w in zip(self.ids, self.starts[:-1], self.starts[1:], weights)
        ]
        return spark.createDataFrame(rows, f"center_id {self.id_type}, c {SPARSE}, weight double")

    def part(self, first: int, last: int) -> "SparseCenters":
        """Rows first to last - 1, under their ids."""
        starts = self.starts[first : last + 1]
        inside = slice(starts[0], starts[-1])
        return SparseCenters(self.dims, starts - starts[0], self.indices[inside], self.values[inside], self.ids[first:last])

    @staticmethod
    def from_rows(rows, id_field: str | None = "center_id", value_field: str = "c") -> "SparseCenters":
        """From collected rows, few enough for the driver; without ``id_field`` numbered as they come."""
        ordered = sorted(rows, key=lambda r: r[id_field]) if id_field else list(rows)
        own = [r[value_field] for r in ordered]
        sizes = {c["size"] for c in own}
        if len(sizes) != 1:
            raise ValueError(f"centres have {sorted(sizes)} coordinates")
        starts = np.cumsum([0, *(len(c["indices"]) for c in own)])
        indices = np.concatenate([np.asarray(c["indices"], np.int64) for c in own])
        values = np.concatenate([np.asarray(c["values"], float) for c in own])
        return SparseCenters(sizes.pop(), starts, indices, values, [r[id_field] for r in ordered] if id_field else [])

    @staticmethod
    def of(centers: "Centers | SparseCenters") -> "SparseCenters":
        """Dense centres, such as means, by their entries other than 0."""
        if isinstance(centers, SparseCenters):
            return centers
        row, column = np.nonzero(centers.matrix)
        starts = np.searchsorted(row, np.arange(len(centers) + 1))
        return SparseCenters(centers.dims, starts, column, centers.matrix[row, column], centers.ids, centers.weights)

    def dense(self) -> Centers:
        """For few centres that join dense ones."""
        matrix = np.zeros((len(self), self.dims))
        matrix[np.repeat(np.arange(len(self)), np.diff(self.starts)), self.indices] = self.values
        return Centers(matrix, self.ids, self.weights)


def sparse_reader(dims: int):
    """A function from an Arrow array of sparse points to (starts, indices, values), checked."""

    def read(x: pa.StructArray):
        import pyarrow.compute as pc

        if x.null_count:
            raise ValueError("points must not be null")
        size, indices, values = (x.field(i) for i in range(3))
        if len(x) and not pc.all(pc.equal(size, dims)).as_py():
            raise ValueError(f"every point must have {dims} coordinates")
        lengths = pc.list_value_length(indices)
        if lengths.null_count or (len(x) and not pc.all(pc.equal(lengths, pc.list_value_length(values))).as_py()):
            raise ValueError("every point must have as many values as indices")
        starts = np.r_[0, np.cumsum(lengths.to_numpy(zero_copy_only=False))].astype(np.int64)
        where = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = values.flatten().to_numpy(zero_copy_only=False)
        if not np.isfinite(numbers).all():
            raise ValueError("coordinates must be finite numbers")
        if len(where) and not (0 <= where.min() and where.max() < dims):
            raise ValueError(f"indices must lie between 0 and {dims - 1}")
        rises = np.diff(where) > 0
        rises[starts[(starts > 0) & (starts < len(where))] - 1] = True  # from one point to the next
        if not rises.all():
            raise ValueError("the indices of a point must rise")
        return starts, where, numbers

    return read


def sparse_finder(centers: SparseCenters, measure: str = "euclidean"):
    """A function from (starts, indices, values) to (distance, row) of the nearest centre, the first on a tie."""
    check_measure(measure)
    k = len(centers)
    owner = np.repeat(np.arange(k), np.diff(centers.starts))
    order = np.argsort(centers.indices, kind="stable")
    columns, first = np.unique(centers.indices[order], return_index=True)
    bounds = np.r_[first, len(order)]
    owner, weight = owner[order], centers.values[order]
    squares = np.bincount(owner, weight * weight, minlength=k)
    matches_at_once, cells = MATCHES, CELLS

    def dots(starts, where, numbers):
        rows = len(starts) - 1
        row = np.repeat(np.arange(rows), np.diff(starts))
        place = np.searchsorted(columns, where)
        held = place < len(columns)
        held[held] = columns[place[held]] == where[held]
        row, place, numbers = row[held], place[held], numbers[held]
        counts = bounds[place + 1] - bounds[place]
        total, done = np.zeros(rows * k), 0
        ends = np.cumsum(counts)
        while done < len(row):
            # some entries at a time, each with all centres that have its column
            until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + matches_at_once, side="right")))
            own = slice(done, until)
            n = counts[own]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[place[own]], n)
            cell = np.repeat(row[own], n) * k + owner[at]
            total += np.bincount(cell, np.repeat(numbers[own], n) * weight[at], minlength=rows * k)
            done = until
        return total.reshape(rows, k)

    def measured(starts, where, numbers):
        own = np.add.reduceat(np.r_[numbers * numbers, 0.0], starts[:-1]) if len(starts) > 1 else np.zeros(0)
        own[np.diff(starts) == 0] = 0.0
        found = dots(starts, where, numbers)
        if measure == "cosine":
            if not (own.all() and squares.all()):
                raise ValueError("cosine distance is not defined for a vector of length zero")
            found = 1.0 - found / (np.sqrt(own)[:, None] * np.sqrt(squares))
        else:
            found = np.maximum(own[:, None] - 2.0 * found + squares, 0.0)
        best = found.argmin(axis=1)
        return found[np.arange(len(found)), best], best

    def find(starts, where, numbers):
        step, parts = max(1, cells // k), []
        for i in range(0, len(starts) - 1, step):
            some = starts[i : i + step + 1]
            parts.append(measured(some - some[0], where[some[0] : some[-1]], numbers[some[0] : some[-1]]))
        if not parts:
            return np.zeros(0), np.zeros(0, np.int64)
        return np.concatenate([d for d, _ in parts]), np.concatenate([w for _, w in parts])

    return find


def nearest_sparse(x: Column, centers: Centers | SparseCenters, measure: str = "euclidean") -> Column:
    """struct(d2, center_id) of the nearest centre of a sparse point; a tie goes to the lowest id."""
    if not len(centers):
        raise ValueError("no centres to measure distances to")
    centers = SparseCenters.of(centers)
    find, read = sparse_finder(centers, measure), sparse_reader(centers.dims)
    ids = pa.array(centers.ids, pa.string() if centers.id_type == "string" else pa.int32())

    @arrow_udf(f"struct<d2:double,center_id:{centers.id_type}>")
    def nearest_center(x: pa.Array) -> pa.Array:
        d2, where = find(*read(x))
        return pa.StructArray.from_arrays([pa.array(d2), ids.take(pa.array(where))], names=["d2", "center_id"])

    # marked so that no filter on the result is pushed below it, which would measure twice
    return nearest_center.asNondeterministic()(x)
