"""k-means||: centres drawn in a few steps, each in proportion to the squared distances.

A step is one scan: distances to all centres so far, then a top-l query. With ``carry`` each point's distance
and centre are kept in a narrow table beside the points instead, and a step measures the newest centres only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import formulas
from ..functions.centers import Centers
from ..operators.carried import CarriedDistances
from ..operators.cost import center_weights, risk
from ..operators.nearest import with_nearest
from ..operators.sampling import random_rows, weighted_draw
from .blackbox import BlackBox, reduce_centers, spark_kmeans
from .result import ClusteringResult, Stopwatch


def kmeans_parallel(
    points: DataFrame,
    k: int,
    *,
    draws: int | None = None,
    l_to_k: float = formulas.L_TO_K_RATIO,
    iterations: int = formulas.INNER_ITERATIONS,
    m: int = 1,
    reducer: BlackBox | None = None,
    seed: int = 1,
    uniform: str = "xxhash64",
    final_risk: bool = True,
    carry: bool = False,
) -> ClusteringResult:
    """One random centre, then ``iterations`` times exactly ``draws`` (l) more, then k of all.

    The loop ends early once every point coincides with a centre. ``carry`` compares a point with each centre once
    in the whole run, for one exchange of the points by their unique point_id at its start; it pays off for
    many steps, centres or dimensions. The result is the same.
    """
    if k < 1 or iterations < 0 or m < 1:
        raise ValueError("k and m must be at least 1, iterations must not be negative")
    spark = points.sparkSession
    watch = Stopwatch()
    draws = formulas.draws_per_step(k, l_to_k) if draws is None else draws
    n = points.count()
    if n == 0:
        raise ValueError("there are no points to cluster")
    with watch.scanning():
        candidates = Centers([random_rows(points, 1, seed, "first", uniform).first().x])
    steps = _carried_steps if carry else _measured_steps
    candidates, cost, comps_per_machine = steps(points, candidates, n, draws, iterations, m, seed, uniform, watch)
    final = reduce_centers(spark, candidates, k, seed, reducer or spark_kmeans())
    risk_final = None
    if final_risk:
        with watch.scanning():
            risk_final = risk(points, final)
    return ClusteringResult(
        "kmeans_parallel", k, final, candidates, len(candidates), iterations, cost, risk_final,
        total_comps=comps_per_machine * m, comps_per_machine=comps_per_machine,
        scan_seconds=watch.scan, total_seconds=watch.total(),
    )


def _measured_steps(points, candidates, n, draws, iterations, m, seed, uniform, watch) -> tuple[Centers, float, float]:
    """All candidates with their weights, their cost, and comparisons per machine in the steps."""
    comps = 0.0
    for step in range(1, iterations + 1):
        with watch.scanning():
            drawn = draw_step(points, candidates, draws, seed, step, uniform).collect()
        if not drawn:
            break
        # each step measures against all candidates so far
        comps += n * len(candidates) // m
        candidates = candidates.appended(Centers([r.x for r in drawn]))
    with watch.scanning():
        return *center_weights(points, candidates), comps


def _carried_steps(points, candidates, n, draws, iterations, m, seed, uniform, watch) -> tuple[Centers, float, float]:
    """The same, each step measuring the newest candidates only."""
    comps, newest = 0.0, candidates
    with CarriedDistances(points) as carried:
        for step in range(1, iterations + 1):
            with watch.scanning():
                carried.add(newest)
                drawn = sorted(carried.draw(draws, seed, step, uniform).collect(), key=lambda r: r.place)
            if not drawn:
                newest = None
                break
            comps += n * len(newest) // m
            newest = Centers([r.x for r in drawn])
            candidates = candidates.appended(newest)
        with watch.scanning():
            if newest is not None:
                carried.add(newest)
            rows = carried.weights().collect()
    found = {r.center_id: r.weight for r in rows}
    weights = [found.get(i, 0.0) for i in range(len(candidates))]
    return candidates.with_weights(weights), float(sum(r.cost for r in rows)), comps


def draw_step(
    points: DataFrame, candidates: Centers, draws: int, seed: int, step: int, uniform: str = "xxhash64"
) -> DataFrame:
    """The rows drawn in one step (at most ``draws``), with their distance so far."""
    scored = with_nearest(points, candidates).drop("center_id")
    return weighted_draw(scored, draws, seed, f"draw{step}", uniform)
