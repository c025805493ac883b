"""Clustering cost, order statistics of distances, and centre weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.centers import CENTER_BYTES, Centers
from ..functions.hashing import POINT_ID, uniform
from ..storage import RunTables
from .nearest import with_distances, with_nearest
from .selection import select


def weight_of(points: DataFrame) -> Column:
    """The weight column of a point table, 1 where it has none."""
    return F.col("w") if "w" in points.columns else F.lit(1.0)


def risk(
    points: DataFrame, centers: Centers, measure: str = "euclidean", tables: RunTables | None = None,
    max_bytes: int = CENTER_BYTES,
) -> float:
    """Sum of the distances to the nearest centres (0 for an empty table)."""
    return costs(points, {"risk": centers}, measure, tables, max_bytes)["risk"]


def costs(
    points: DataFrame, centers: dict[str, Centers], measure: str = "euclidean", tables: RunTables | None = None,
    max_bytes: int = CENTER_BYTES,
) -> dict[str, float]:
    """Cost of several centre sets in one scan."""
    names = list(centers)
    scored = points.select("x", weight_of(points).alias("weight"))
    scored = with_distances(scored, {f"d{i}": centers[name] for i, name in enumerate(names)}, measure, tables, max_bytes)
    row = scored.agg(*[F.sum(F.col(f"d{i}") * F.col("weight")).alias(f"d{i}") for i in range(len(names))]).first()
    return {n: row[f"d{i}"] or 0.0 for i, n in enumerate(names)}


def truncated_risk(scored: DataFrame, r: int, d2: str = "d2") -> float:
    """Sum of all but the r largest distances; 0 if there are no more than r rows.

    The r-th largest distance comes from counting ranges (``select``), for any r. What lies below it is summed by
    the same aggregates, never as total minus top. Of the rows at that distance itself, the heaviest are the
    ones left out; weights that differ there are selected in the same way.
    """
    weight = weight_of(scored)
    if r <= 0:
        return scored.agg(F.sum(F.col(d2) * weight)).first()[0] or 0.0
    rows = scored.select(F.col(d2).cast("double").alias("d"), weight.cast("double").alias("weight"))
    cut = select(rows, "d", r, {"cost": F.col("d") * F.col("weight"), "weight": F.col("weight")})
    if cut is None:
        return 0.0
    left_out = r - cut.above
    kept = cut.equal - left_out
    if kept == 0 or cut.value == 0:
        return cut.sums_below["cost"]
    if "w" not in scored.columns:
        return cut.sums_below["cost"] + cut.value * kept
    edge = rows.where(F.col("d") == F.lit(cut.value))
    # the weights that stay are those below the heaviest ones
    weights = select(edge, "weight", left_out, {"weight": F.col("weight")})
    at_edge = weights.sums_below["weight"] + weights.value * (weights.above + weights.equal - left_out)
    return cut.sums_below["cost"] + cut.value * at_edge


def tail_distance(scored: DataFrame, rank: int, d2: str = "d2") -> tuple[float | None, bool]:
    """The rank-th largest distance and True; the smallest one and False if there are fewer rows."""
    cut = select(scored, d2, max(1, rank))
    if cut is not None:
        return cut.value, True
    return scored.agg(F.min(F.col(d2))).first()[0], False


def weight_table(
    points: DataFrame,
    centers: Centers | DataFrame,
    measure: str = "euclidean",
    tables: RunTables | None = None,
    max_bytes: int = CENTER_BYTES,
) -> DataFrame:
    """(center_id, c, weight, cost): points nearest to each centre, 0 where there are none.

    Partial sums per task come before the exchange, so a centre that owns a third of the
    rows costs no more than any other.
    """
    assigned = with_nearest(points, centers, measure, tables, max_bytes)
    weight = weight_of(points)
    counted = assigned.groupBy("center_id").agg(
        F.sum(weight).alias("weight"), F.sum(F.col("d2") * weight).alias("cost")
    )
    every = centers if isinstance(centers, DataFrame) else centers.to_df(points.sparkSession)
    return every.select("center_id", "c").join(counted, "center_id", "left").na.fill(0.0, ["weight", "cost"])


def center_weights(
    points: DataFrame, centers: Centers, measure: str = "euclidean", tables: RunTables | None = None,
    max_bytes: int = CENTER_BYTES,
) -> tuple[Centers, float]:
    """Centres with their weights, and the cost of the whole set, from one scan."""
    assigned = with_nearest(points, centers, measure, tables, max_bytes)
    weight = weight_of(points)
    rows = (
        assigned.groupBy("center_id")
        .agg(F.sum(weight).alias("weight"), F.sum(F.col("d2") * weight).alias("cost"))
        .collect()
    )
    found = {r.center_id: r.weight for r in rows}
    weights = np.array([found.get(i, 0.0) for i in centers.ids])
    return centers.with_weights(weights), float(sum(r.cost for r in rows))


def weights_of_sets(
    points: DataFrame, sets: dict[str, Centers], measure: str = "euclidean", tables: RunTables | None = None,
    max_bytes: int = CENTER_BYTES,
) -> dict[str, tuple[Centers, float]]:
    """``center_weights`` of several sets in one scan: each point gives a row per set to the sums of its task."""
    names = list(sets)
    scored = points.select("x", weight_of(points).alias("weight"))
    for i, name in enumerate(names):
        scored = with_nearest(scored, sets[name], measure, tables, max_bytes).withColumnsRenamed({"d2": f"d{i}", "center_id": f"c{i}"})
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("c"), F.col(f"d{i}").alias("d")) for i in range(len(names))])
    rows = (
        scored.select("weight", F.explode(each).alias("e")).groupBy("e.i", "e.c")
        .agg(F.sum("weight").alias("weight"), F.sum(F.col("e.d") * F.col("weight")).alias("cost")).collect()
    )
    found = {}
    for i, name in enumerate(names):
        own = {r.c: r for r in rows if r.i == i}
        weights = [own[c].weight if c in own else 0.0 for c in sets[name].ids]
        found[name] = sets[name].with_weights(weights), float(sum(r.cost for r in own.values()))
    return found


def machine_of(points: DataFrame, machines: int, method: str = "xxhash64") -> Column:
    """The machine that a point is dealt to: by a hash of its key, without key by the partition that it lies in."""
    if POINT_ID not in points.columns:
        return F.spark_partition_id() % machines
    return F.floor(uniform(points, 0, "machine", method) * machines).cast("int")


def machine_rows(points: DataFrame, machines: int, method: str = "xxhash64") -> list[int]:
    """Rows of each machine that has any, in one scan of the keys."""
    return [r["count"] for r in points.groupBy(machine_of(points, machines, method).alias("machine")).count().collect()]
