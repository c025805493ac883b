"""Points joined with their nearest centre."""

from __future__ import annotations

import math
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distance
from ..functions.centers import CENTER_BYTES, Centers, center_table_size
from ..functions.sparse import SparseCenters, is_sparse, nearest_sparse
from ..storage import RunTables

# Points, in bytes, that a task measures against all blocks before it takes more.
GROUP_BYTES = 32 * 1024 * 1024
# Rows of such a group that are compared with a block at once.
SLICE_ROWS = 1 << 16
# Coordinates whose ranges are taken, those of them that order centres in space, and bits of each.
BOX_DIMS, BOX_BITS = (64, 4), 8


def with_nearest(
    points: DataFrame,
    centers: Centers | DataFrame,
    measure: str = "euclidean",
    tables: RunTables | None = None,
    max_bytes: int = CENTER_BYTES,
) -> DataFrame:
    """Adds d2 and center_id of the nearest centre to every point.

    Centre sets up to ``max_bytes`` travel with the tasks. A larger one is written to the shared folder, and
    every task reads it block by block for each group of its points, in one pass over them: no task
    holds more than a block and a group. Without ``tables`` it lies in a folder of its own, as
    the returned frame reads it. Sparse points take sparse or dense centres; what is too large for a task goes
    along in parts, of which each point keeps the nearest.
    """
    if is_sparse(points):
        return _sparse_pass(points, centers, measure, max_bytes)
    centers, size = fetched(centers, max_bytes)
    if size <= max_bytes:
        return _one_pass(points, centers, measure)
    return _in_blocks(points, [(centers, size, "d2", "center_id")], measure, tables, max_bytes)


def with_distances(
    points: DataFrame, sets: dict[str, Centers], measure: str = "euclidean", tables: RunTables | None = None,
    max_bytes: int = CENTER_BYTES,
) -> DataFrame:
    """Adds the distance to the nearest centre of each set, in a column of the set's name.

    All sets that go block by block are read by the same tasks, one after the other for a group of points.
    """
    found, large = points, []
    for name, centers in sets.items():
        if not is_sparse(points) and centers.nbytes > max_bytes:
            large.append((centers, centers.nbytes, name, None))
        else:
            found = with_nearest(found, centers, measure, tables, max_bytes).drop("center_id").withColumnRenamed("d2", name)
    return _in_blocks(found, large, measure, tables, max_bytes) if large else found


def fetched(centers: Centers | DataFrame, max_bytes: int = CENTER_BYTES) -> tuple[Centers | DataFrame, int]:
    """A centre table brought to the driver if it has no more than ``max_bytes``, and its size."""
    if not isinstance(centers, DataFrame):
        return centers, centers.nbytes
    _, size = center_table_size(centers)
    if size > max_bytes:
        return centers, size
    kind = SparseCenters if is_sparse(centers, "c") else Centers
    return kind.from_rows(centers.select("center_id", "c").collect()), size


def _one_pass(points: DataFrame, centers: Centers, measure: str) -> DataFrame:
    found = points.select("*", distance.nearest(F.col("x"), centers, measure).alias("nearest"))
    return found.select("*", "nearest.d2", "nearest.center_id").drop("nearest")


def _sparse_pass(points: DataFrame, centers, measure: str, max_bytes: int) -> DataFrame:
    if isinstance(centers, DataFrame):
        centers, size = fetched(centers, max_bytes)
        if size > max_bytes:
            raise ValueError(f"a table of sparse centres has {size} bytes, more than the {max_bytes} that travel with a task")
    centers = SparseCenters.of(centers)
    parts = max(1, math.ceil(centers.nbytes / max_bytes))
    per_part = math.ceil(len(centers) / parts)
    found = points
    for i, first in enumerate(range(0, len(centers), per_part)):
        # parts in ascending order of ids, so that a tie stays with the earlier one
        near = nearest_sparse(F.col("x"), centers.part(first, first + per_part), measure)
        found = found.select("*", near.alias("near"))
        if i == 0:
            found = found.select("*", "near.d2", "near.center_id").drop("near")
        else:
            closer = F.col("near.d2") < F.col("d2")
            found = found.withColumns({
                "center_id": F.when(closer, F.col("near.center_id")).otherwise(F.col("center_id")),
                "d2": F.least("d2", "near.d2"),
            }).drop("near")
    return found


def _stored(centers, size, tables, max_bytes):
    """Files of a written centre table, rows of a block, coordinates, and the type of its ids."""
    # Centres that lie close together share a file and a block, whose box tells which points need not be measured.
    name = f"nearest-{uuid4().hex}"
    files = max(1, math.ceil(size / max_bytes))
    chosen = centers.select("center_id", "c")
    place = _place(chosen)
    stored = tables.write(chosen.repartitionByRange(files, place, "center_id").sortWithinPartitions(place, "center_id"), name)
    row = stored.agg(F.count("*").alias("n"), F.min(F.size("c")).alias("low"), F.max(F.size("c")).alias("high")).first()
    if row.low != row.high:
        raise ValueError(f"centres have {row.low} to {row.high} coordinates")
    return sorted(stored.inputFiles()), max(1, int(max_bytes / (size / row.n))), row.high, stored.schema["center_id"].dataType


def _in_blocks(points, sets, measure, tables, max_bytes) -> DataFrame:
    """Adds columns for each of ``sets``: (centres, their bytes, name of the distance, name of the id or None)."""
    spark = points.sparkSession
    tables = RunTables(spark) if tables is None else tables
    fields, plans = [], []
    for centers, size, d2_name, id_name in sets:
        table = centers.to_df(spark) if isinstance(centers, Centers) else centers
        paths, rows, dims, id_type = _stored(table, size, tables, max_bytes)
        plans.append((paths, rows, distance.matrix_reader(dims), d2_name, id_name))
        fields.append(T.StructField(d2_name, T.DoubleType()))
        if id_name:
            fields.append(T.StructField(id_name, id_type))
    group_bytes, find_in = max(max_bytes, GROUP_BYTES), distance.nearest_finder
    schema = T.StructType([*points.schema.fields, *fields])

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        def blocks(paths, rows, read_points):
            for path in paths:
                system, inside = fs.FileSystem.from_uri(path)
                with system.open_input_file(inside) as source:
                    for block in pq.ParquetFile(source).iter_batches(rows, columns=["center_id", "c"]):
                        yield block.column("center_id"), read_points(block.column("c"))

        def nearest_of(values, plan):
            paths, per_block, read_points, _, id_name = plan
            best, ids = np.full(len(values), np.inf), np.full(len(values) if id_name else 0, None, dtype=object)
            for names, table in blocks(paths, per_block, read_points):
                find, order, low, high = None, None, table.min(axis=0), table.max(axis=0)
                for start in range(0, len(values), SLICE_ROWS):
                    rows = np.arange(start, min(len(values), start + SLICE_ROWS))
                    if measure == "euclidean":
                        # only points that the block's box may hold a nearer centre for, or one as near
                        own = values[start : start + SLICE_ROWS]
                        gap = np.maximum(np.maximum(low - own, own - high), 0.0)
                        rows = rows[np.einsum("ij,ij->i", gap, gap) <= best[rows] * (1 + 1e-9)]
                    if not len(rows):
                        continue
                    if find is None:
                        order = np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")
                        find = find_in(table[order], measure)
                    d2, where = find(values[rows])
                    closer = d2 < best[rows]
                    if id_name:
                        found = names.to_numpy(zero_copy_only=False)[order][where]
                        for i in np.flatnonzero(d2 == best[rows]):
                            closer[i] = found[i] < ids[rows[i]]
                        ids[rows[closer]] = found[closer]
                    best[rows[closer]] = d2[closer]
            return best, pa.array(ids.tolist(), names.type)

        def scored(held):
            group = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            for plan in plans:
                # checks the number of coordinates against those of this set
                values = np.concatenate([plan[2](part) for part in group.column("x").chunks])
                best, named = nearest_of(values, plan)
                group = group.append_column(plan[3], pa.array(best))
                if plan[4]:
                    group = group.append_column(plan[4], named)
            yield from group.to_batches()

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= group_bytes:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    return points.mapInArrow(run, schema)


def _place(centers: DataFrame):
    """A number that is alike for centres close to each other: bits of their widest coordinates, interleaved."""
    dims = centers.select(F.size("c").alias("n")).first()
    if dims is None:
        return F.lit(0)
    some = range(min(dims.n, BOX_DIMS[0]))
    bounds = centers.agg(*[f(F.col("c")[j]).alias(f"{n}{j}") for j in some for n, f in (("low", F.min), ("high", F.max))]).first()
    spread = {j: bounds[f"high{j}"] - bounds[f"low{j}"] for j in some if (bounds[f"high{j}"] or 0) > (bounds[f"low{j}"] or 0)}
    place, widest = F.lit(0).cast("bigint"), sorted(spread, key=lambda j: -spread[j])[: BOX_DIMS[1]]
    for i, j in enumerate(widest):
        cell = F.floor((F.col("c")[j] - F.lit(bounds[f"low{j}"])) / F.lit(spread[j]) * ((1 << BOX_BITS) - 1)).cast("bigint")
        for bit in range(BOX_BITS):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(1), bit * len(widest) + i))
    return place


def closer_of(points: DataFrame, previous: str, current: str) -> DataFrame:
    """Running minimum as centres are added: ``current`` becomes least(previous, current)."""
    return points.withColumn(current, F.least(F.col(previous), F.col(current)))


def predict(
    points: DataFrame, centers: Centers, output: str = "prediction", measure: str = "euclidean", x: str = "x"
) -> DataFrame:
    """Appends the id of the nearest centre."""
    if is_sparse(points, x):
        return points.select("*", nearest_sparse(F.col(x), centers, measure)["center_id"].alias(output))
    if centers.nbytes <= CENTER_BYTES:
        pair = distance.nearest(F.col(x), centers, measure)
        return points.select("*", pair["center_id"].alias(output))
    # A column of its own in a struct keeps the names of the input out of the way.
    rows = points.select(F.struct("*").alias("row"), F.col(x).alias("x"))
    return with_nearest(rows, centers, measure).select("row.*", F.col("center_id").alias(output))
