"""Distance from every point to its nearest centre.

One Arrow UDF receives the coordinates of a batch and returns the squared distance to the
nearest centre together with that centre's id. Nothing is shuffled: the scan, the UDF and
whatever aggregates its result run in one stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .centers import Centers

MEASURES = ("euclidean", "cosine")


def check_measure(measure: str) -> str:
    if measure not in MEASURES:
        raise ValueError(f"distance measure must be one of {MEASURES}, got {measure!r}")
    return measure


def squared_distance(x: Column, center) -> Column:
    """Squared Euclidean distance to one fixed centre, as a plain expression."""
    total = None
    for i, value in enumerate(center):
        gap = x[i] - F.lit(float(value))
        total = gap * gap if total is None else total + gap * gap
    return total


def nearest_finder(table: np.ndarray, measure: str = "euclidean"):
    """A function from a matrix of points to (distance, row of ``table``) of the nearest row, the first on a tie.

    Everything it needs is local to it, so it ships by value and the workers need no copy of
    this package.
    """
    check_measure(measure)
    table = np.ascontiguousarray(table)
    dims = table.shape[1]

    def all_distances(block, some):
        # two buffers of a size that stays in the cache, reused for every coordinate
        found, gap = np.empty((2, len(block), len(some)))
        np.subtract(block[:, 0:1], some[:, 0], out=found)
        found *= found
        for j in range(1, dims):
            np.subtract(block[:, j : j + 1], some[:, j], out=gap)
            gap *= gap
            found += gap
        best = found.argmin(axis=1)
        return found[np.arange(len(block)), best], best

    def screened_distances(block, some):
        # A matrix product screens the pairs; those within its rounding error of the minimum
        # are measured again coordinate by coordinate, so the result equals all_distances.
        # (The point's own square is the same for all centres and is left out of the screen.)
        squares = np.einsum("ij,ij->i", some, some)
        rough = block @ (-2.0 * some.T)
        rough += squares
        slack = 1e-12 * dims * (np.einsum("ij,ij->i", block, block) + squares.max())
        row, col = np.nonzero(rough <= (rough.min(axis=1) + slack)[:, None])
        exact = np.zeros(len(row))
        for j in range(dims):
            gap = block[row, j] - some[col, j]
            exact += gap * gap
        starts = np.searchsorted(row, np.arange(len(block)))
        least = np.minimum.reduceat(exact, starts)
        hits = np.flatnonzero(exact == least[row])
        first = hits[np.searchsorted(row[hits], np.arange(len(block)))]
        return exact[first], col[first]

    def cosine_distances(block, some):
        dots = np.zeros((len(block), len(some)))
        sizes, other_sizes = np.zeros(len(block)), np.zeros(len(some))
        for j in range(dims):
            dots += block[:, j : j + 1] * some[:, j]
            sizes += block[:, j] * block[:, j]
            other_sizes += some[:, j] * some[:, j]
        if not (sizes.all() and other_sizes.all()):
            raise ValueError("cosine distance is not defined for a vector of length zero")
        found = 1.0 - dots / (np.sqrt(sizes)[:, None] * np.sqrt(other_sizes))
        best = found.argmin(axis=1)
        return found[np.arange(len(block)), best], best

    def measured(values, some):
        if measure == "cosine":
            way = cosine_distances
        else:
            way = screened_distances if dims >= 8 and len(some) >= 8 else all_distances
        step = max(1, 65536 // len(some))
        parts = [way(values[i : i + step], some) for i in range(0, len(values), step)]
        return np.concatenate([d for d, _ in parts]), np.concatenate([w for _, w in parts])

    def split(matrix, most):
        """Rows in groups of at most ``most``, halved along the widest axis again and again."""
        todo, groups = [np.arange(len(matrix))], []
        while todo:
            rows = todo.pop()
            if len(rows) <= most:
                groups.append(rows)
                continue
            own = matrix[rows]
            widest = int((own.max(axis=0) - own.min(axis=0)).argmax())
            halves = np.argpartition(own[:, widest], len(rows) // 2)
            todo += [rows[halves[: len(rows) // 2]], rows[halves[len(rows) // 2 :]]]
        return groups

    # Many centres lie in leaves of 16, these in boxes of 16 leaves. Some close centres bound the distance of a group of
    # points; a box farther from the group's own box than that holds no centre that is nearest to any of them, nor ties.
    # Of the boxes that are left each point looks at those within its distance to the centres of a leaf close by, of
    # their leaves likewise, and is measured against the centres of what remains.
    boxes = split(table, 256) if measure == "euclidean" and len(table) >= 512 else []
    # in ascending order, so that a tie goes to the lowest; the last again where there are fewer than 16
    leaves = [[np.pad(np.sort(box[leaf]), (0, 16 - len(leaf)), mode="edge") for leaf in split(table[box], 16)] for box in boxes]
    members = np.array([leaf for own in leaves for leaf in own], dtype=np.int32)
    ends = np.cumsum([len(own) for own in leaves])
    of_box = np.array([np.pad(np.arange(end - len(own), end), (0, 16 - len(own)), mode="edge") for own, end in zip(leaves, ends)])
    # coordinates of the centres of a leaf, and ranges of leaves, by dimension; taken in the task, so that they do not travel
    within, ranges = [], []
    lows = np.array([table[box].min(axis=0) for box in boxes])
    highs = np.array([table[box].max(axis=0) for box in boxes])

    def in_leaves(points, own):
        """(distance, row) of the nearest centre of leaf ``own[i]`` for point i."""
        found = points[:, 0:1] - within[0][own]
        found *= found
        for j in range(1, dims):
            gap = points[:, j : j + 1] - within[j][own]
            gap *= gap
            found += gap
        best = found.argmin(axis=1)
        return found[np.arange(len(points)), best], members[own, best]

    def gaps_to(points, bounds):
        """Squared distance from each point to each range of ``bounds``, (low, high) by dimension."""
        total = None
        for j, (low, high) in enumerate(bounds):
            x = points[:, j : j + 1]
            gap = np.maximum(low - x, x - high)
            np.maximum(gap, 0.0, out=gap)
            gap *= gap
            total = gap if total is None else np.add(total, gap, out=total)
        return total

    def leaf_gaps(points, box):
        own = of_box[box]
        return gaps_to(points, [(low[own], high[own]) for low, high in ranges])

    def boxed(values):
        d2, where = np.empty(len(values)), np.empty(len(values), dtype=np.int64)
        if not within:
            within.extend(np.ascontiguousarray(table[members, j]) for j in range(dims))
            ranges.extend((w.min(axis=1), w.max(axis=1)) for w in within)
        for rows in split(values, 256):
            group = values[rows]
            low, high = group.min(axis=0), group.max(axis=0)
            middle = (low + high) / 2
            near = int(((np.clip(middle, lows, highs) - middle) ** 2).sum(axis=1).argmin())
            bound = measured(group, table[boxes[near]])[0].max()
            gap = np.maximum(np.maximum(lows - high, low - highs), 0.0)
            slack = 1e-9 * max(np.abs(low).max(), np.abs(high).max()) ** 2
            kept = np.flatnonzero((gap * gap).sum(axis=1) <= bound * (1 + 1e-9) + slack)
            to_box = gaps_to(group, [(lows[kept, j], highs[kept, j]) for j in range(dims)])
            closest = kept[to_box.argmin(axis=1)]
            reach = in_leaves(group, of_box[closest, leaf_gaps(group, closest).argmin(axis=1)])[0]
            reach = reach * (1 + 1e-9) + slack
            point, box = np.nonzero(to_box <= reach[:, None])
            if len(point) > 8 and len(point) > to_box.size // 2:
                # hardly any box is out of reach, as in many dimensions
                some = np.sort(np.concatenate([boxes[i] for i in kept]))
                d2[rows], found = measured(group, table[some])
                where[rows] = some[found]
                continue
            box = kept[box]
            parts = []
            for i in range(0, len(point), 2048):
                p, b = point[i : i + 2048], box[i : i + 2048]
                at, leaf = np.nonzero(leaf_gaps(group[p], b) <= reach[p, None])
                for j in range(0, len(at), 4096):
                    of = p[at[j : j + 4096]]
                    parts.append((of, *in_leaves(group[of], of_box[b[at[j : j + 4096]], leaf[j : j + 4096]])))
            point, apart, row = (np.concatenate(x) for x in zip(*parts))
            starts = np.searchsorted(point, np.arange(len(group)))
            d2[rows] = least = np.minimum.reduceat(apart, starts)
            where[rows] = np.minimum.reduceat(np.where(apart == least[point], row, len(table)), starts)
        return d2, where

    def find(values):
        if not len(values):
            return np.empty(0), np.empty(0, dtype=np.int64)
        if len(boxes):
            return boxed(values)
        return measured(values, table)

    return find


def matrix_reader(dims: int):
    """A function from an Arrow array of coordinate lists to a matrix; every list must have ``dims`` numbers."""

    def read(x: pa.Array) -> np.ndarray:
        import pyarrow.compute as pc

        if x.null_count or (len(x) and not pc.all(pc.equal(pc.list_value_length(x), dims)).as_py()):
            raise ValueError(f"every point must have {dims} coordinates")
        values = x.flatten().to_numpy(zero_copy_only=False)
        if not np.isfinite(values).all():
            raise ValueError("coordinates must be finite numbers")
        return values.reshape(-1, dims)

    return read


def nearest(x: Column, centers: Centers, measure: str = "euclidean") -> Column:
    """struct(d2, center_id) of the nearest centre; a tie goes to the lowest id."""
    if not len(centers):
        raise ValueError("no centres to measure distances to")
    find, read = nearest_finder(centers.matrix, measure), matrix_reader(centers.dims)
    ids = pa.array(centers.ids, pa.string() if centers.id_type == "string" else pa.int32())

    @arrow_udf(f"struct<d2:double,center_id:{centers.id_type}>")
    def nearest_center(x: pa.Array) -> pa.Array:
        d2, where = find(read(x))
        return pa.StructArray.from_arrays([pa.array(d2), ids.take(pa.array(where))], names=["d2", "center_id"])

    # Marked so that no filter on the result is pushed below it, which would measure twice.
    return nearest_center.asNondeterministic()(x)
