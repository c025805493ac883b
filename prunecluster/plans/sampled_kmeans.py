"""k-means by sampling and pruning.

Each round reads the survivors twice: once to draw both samples, once to drop the points that
the new centres serve well. The inner clustering sees only a sample whose size hardly depends
on the size of the data. After the rounds two more scans of all points give the weights of the
candidate centres and the cost of the final ones.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions.centers import Centers
from ..functions.distance import check_measure
from ..functions.sparse import SparseCenters, is_sparse
from ..operators.cost import center_weights, costs, machine_rows, risk, weights_of_sets
from ..operators.nearest import with_nearest
from ..operators.rounds import estimate, prune
from ..operators.sampling import exact_samples, paired_sample
from ..storage import RunTables
from .blackbox import BlackBox, named_blackbox, reduce_centers, spark_kmeans
from .result import ClusteringResult, Stopwatch

# Rows of a sample that one k-means task works on.
SAMPLE_ROWS_PER_TASK = 50_000


def check_parameters(k: int, epsilon: float, delta: float, max_iter: int | None, m: int | None = None) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    if not 0 < epsilon < 1:
        raise ValueError(f"epsilon must lie between 0 and 1, got {epsilon}")
    if not 0 < delta < 1:
        raise ValueError(f"delta must lie between 0 and 1, got {delta}")
    if max_iter is not None and max_iter < 0:
        raise ValueError(f"max_iter must not be negative, got {max_iter}")
    if m is not None and m < 1:
        raise ValueError(f"m must be at least 1, got {m}")


def sampled_kmeans(
    points: DataFrame,
    k: int,
    epsilon: float = 0.05,
    delta: float = formulas.DELTA,
    *,
    m: int | None = None,
    blackbox: str | BlackBox = "kmeans",
    reducer: BlackBox | None = None,
    max_iter: int | None = 20,
    seed: int = 1,
    uniform: str = "xxhash64",
    disjoint: bool = False,
    exact_sizes: bool = False,
    measure: str = "euclidean",
    final_risk: bool = True,
    run_name: str | None = None,
    finish: bool = True,
) -> ClusteringResult:
    """Clusters ``points`` (x ARRAY<DOUBLE> or sparse, optional point_id and weight w) into k centres.

    With a unique point_id the draws do not depend on how the table is partitioned. ``exact_sizes`` draws
    round(alpha * survivors) rows each instead of a share alpha by chance; this costs passes over the ids. ``m`` spreads
    the points over that many partitions first, and is the number of machines that the counters assume; leave it out
    for files that are already split. With a ``run_name`` every round leaves a note in the shared folder, and a
    run of that name that was stopped goes on behind its last whole round; its draws need a point_id for that.
    Without ``finish`` the candidates are returned as they are, for ``finish_runs`` to weigh and reduce.
    ``max_iter`` bounds the rounds (None: no bound), and a round that prunes nothing ends them: whatever is left is
    clustered by the distributed black box, so no row is lost.
    """
    check_parameters(k, epsilon, delta, max_iter, m)
    check_measure(measure)
    if exact_sizes and disjoint:
        raise ValueError("samples of exact size are independent draws, not halves of one")
    spark = points.sparkSession
    watch = Stopwatch()
    distributed = spark_kmeans(measure=measure)
    inner, few = named_blackbox(blackbox, k, distributed)
    columns = [c for c in ("point_id", "x", "w") if c in points.columns]
    points = points.select(*columns)
    machines = m or formulas.MACHINES
    setting = dict(k=k, epsilon=epsilon, delta=delta, seed=seed, uniform=uniform, machines=machines, columns=columns,
                   disjoint=disjoint, exact_sizes=exact_sizes, measure=measure)
    if run_name and "point_id" not in columns:
        raise ValueError("a run that can be resumed needs a unique point_id column")
    spread = None
    if m is not None:
        points = spread = points.repartition(m).persist(StorageLevel.MEMORY_AND_DISK)

    try:
        with RunTables(spark, run_name) as tables:
            before = tables.last_note() if run_name else None
            if before is not None and before["setting"] != setting:
                raise ValueError(f"run {run_name!r} was started with {before['setting']}, not with {setting}")
            with watch.scanning():
                rows = before["machine_rows"] if before else machine_rows(points, machines, uniform)
            n, largest = sum(rows), max(rows, default=0)
            if n == 0:
                raise ValueError("there are no points to cluster")
            capacity = formulas.max_subset(n, k, epsilon, delta)
            if capacity <= 0:
                raise ValueError(f"the survivors must be allowed at least one row, got {capacity}")
            k_plus = formulas.oversampled_k(k, delta, epsilon)

            survivors, remaining, psi = points, n, 0.0
            candidates: Centers | None = None
            rounds, comps, comps_per_machine, stuck = [], 0.0, 0.0, False
            if before is not None:
                rounds, remaining, largest, psi = (before[key] for key in ("rounds", "remaining", "largest", "psi"))
                comps, comps_per_machine, stuck = before["comps"], before["comps_per_machine"], before["stuck"]
                candidates = Centers(np.array(before["candidates"]))
                survivors = tables.read(f"survivors-{before['turn']}", points.schema)
            while remaining > capacity and (max_iter is None or len(rounds) < max_iter) and not stuck:
                round_no = len(rounds) + 1
                alpha = formulas.sampling_rate(capacity, remaining)
                if exact_sizes:
                    drawn = exact_samples(survivors, {"p1": alpha, "p2": alpha}, seed, round_no, uniform)
                else:
                    drawn = paired_sample(survivors, alpha, seed, round_no, uniform, disjoint)
                tasks = max(1, math.ceil(2 * capacity / SAMPLE_ROWS_PER_TASK))
                seen = Observation()
                # counted behind the exchange, in the writing stage, where a lost task counts once
                drawn = drawn.repartition(tasks).observe(
                    seen, F.count_if("p1").alias("p1"), F.count_if("p2").alias("p2")
                )
                with watch.scanning():
                    sample = tables.write(drawn, f"sample-{round_no}")
                p1_rows, p2_rows = seen.get["p1"], seen.get["p2"]
                if p1_rows == 0:
                    break
                centers = inner(sample.where("p1").select(*columns), k_plus, seed + round_no)
                step = estimate(
                    sample.where("p2").select(*columns), centers, alpha, k, delta, epsilon, psi, measure
                )
                psi = step.psi
                comps += remaining * len(centers)
                comps_per_machine += largest * len(centers)
                name = f"survivors-{round_no}"
                with watch.scanning():
                    pruned = prune(
                        with_nearest(survivors, centers, measure), step.v, tables, name, columns, machines, uniform
                    )
                rounds.append(
                    dict(
                        round=round_no, remaining=remaining, alpha=alpha, p1_rows=p1_rows, p2_rows=p2_rows,
                        center_count=len(centers), r=step.r, truncated_risk=float(step.truncated_risk), psi=psi,
                        v=step.v, handled=pruned.handled, handled_risk=float(pruned.handled_risk),
                        survivors=pruned.remaining,
                    )
                )
                candidates = centers.appended(None) if candidates is None else candidates.appended(centers)
                survivors, remaining, largest = pruned.survivors, pruned.remaining, pruned.largest
                stuck = pruned.handled == 0
                if run_name:
                    tables.note(dict(
                        turn=round_no, setting=setting, machine_rows=rows, rounds=rounds, remaining=remaining, largest=largest, psi=psi,
                        comps=comps, comps_per_machine=comps_per_machine, stuck=stuck, candidates=candidates.matrix.tolist(),
                    ))
                tables.drop(f"sample-{round_no}")
                if round_no > 1:
                    tables.drop(f"survivors-{round_no - 1}")

            capped = remaining > capacity
            if remaining > 0:
                last = last_centers(survivors, remaining, k, few, inner, seed)
                candidates = last if candidates is None else candidates.appended(last)

            cost, final, risk_final = float("nan"), None, None
            if finish:
                with watch.scanning():
                    candidates, cost = center_weights(points, candidates, measure, tables)
                final = reduce_centers(spark, candidates, k, seed, reducer or distributed)
            if finish and final_risk:
                with watch.scanning():
                    risk_final = risk(points, final, measure, tables)
    finally:
        if spread is not None:
            spread.unpersist()

    return ClusteringResult(
        "sampled_kmeans", k, final, candidates, len(candidates), len(rounds), cost, risk_final,
        total_comps=comps, comps_per_machine=comps_per_machine, capacity=capacity,
        scan_seconds=watch.scan, total_seconds=watch.total(), rounds=rounds, capped=capped,
    )


def finish_runs(
    points: DataFrame, runs: dict[int, ClusteringResult], k: int, *, reducer: BlackBox | None = None, measure: str = "euclidean",
) -> dict[int, ClusteringResult]:
    """Weights, reduces and costs several runs over the same points (by seed, run without ``finish``) in two scans in all."""
    watch = Stopwatch()
    columns = [c for c in ("x", "w") if c in points.columns]
    points = points.select(*columns)
    with RunTables(points.sparkSession) as tables:
        with watch.scanning():
            weighed = weights_of_sets(points, {str(s): r.candidates for s, r in runs.items()}, measure, tables)
        box = reducer or spark_kmeans(measure=measure)
        finals = {s: reduce_centers(points.sparkSession, weighed[str(s)][0], k, s, box) for s in runs}
        with watch.scanning():
            risks = costs(points, {str(s): c for s, c in finals.items()}, measure, tables)
    share = len(runs)
    return {
        s: replace(
            r, centers=finals[s], candidates=weighed[str(s)][0], risk=weighed[str(s)][1], risk_final=risks[str(s)],
            scan_seconds=r.scan_seconds + watch.scan / share, total_seconds=r.total_seconds + watch.total() / share,
        )
        for s, r in runs.items()
    }


def last_centers(survivors: DataFrame, remaining: int, k: int, few: int, inner: BlackBox, seed: int) -> Centers:
    """Centres of the last survivors: the rows themselves if there are few, else k of them."""
    if remaining <= few:
        key = ["point_id"] if "point_id" in survivors.columns else ["x"]
        rows = survivors.orderBy(*key).select("x").collect()
        return SparseCenters.from_rows(rows, None, "x").dense() if is_sparse(survivors) else Centers([r.x for r in rows])
    return inner(survivors, k, seed)
