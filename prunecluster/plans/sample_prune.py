"""Sample and prune: a growing sample serves as centres, a second one picks the pivot distance.

The sample grows with n^epsilon and may outgrow a task, so it stays a table; the nearest
sample row is found in blocks once it is larger than one task should hold. Survivors carry
their distance to the sample so far, so a round only measures against what was added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions.centers import CENTER_BYTES
from ..operators.cost import machine_rows, risk, tail_distance, weight_table
from ..operators.nearest import closer_of, fetched, with_nearest
from ..operators.rounds import prune
from ..operators.sampling import two_samples
from ..storage import RunTables
from .blackbox import BlackBox, spark_kmeans
from .result import ClusteringResult, Stopwatch


def sample_prune(
    points: DataFrame,
    k: int,
    epsilon: float = 0.05,
    *,
    reducer: BlackBox | None = None,
    max_iter: int | None = None,
    min_iter: int = 0,
    seed: int = 1,
    uniform: str = "xxhash64",
    final_risk: bool = True,
    center_bytes: int = CENTER_BYTES,
    keep_centers: bool = False,
    machines: int = formulas.MACHINES,
) -> ClusteringResult:
    """Clusters ``points`` (point_id, x[, w]) into k centres.

    Rounds go on until few enough rows survive. ``max_iter`` bounds them, and a round that prunes nothing ends them;
    ``min_iter`` rounds are done however few rows there are. All survivors join the sample, also beyond
    the stop size; the result says so (``capped``).

    ``machines`` is how many the counter of one machine's comparisons assumes; points are dealt to them by hash.
    ``keep_centers`` returns the weighted sample as a table of its own in the shared folder.
    """
    if k < 1 or not 0 < epsilon < 1 or not 0 <= min_iter <= (min_iter if max_iter is None else max_iter):
        raise ValueError("k must be at least 1, epsilon between 0 and 1, min_iter not negative and at most max_iter")
    if "point_id" not in points.columns:
        raise ValueError("sample_prune needs a unique point_id column")
    spark = points.sparkSession
    watch = Stopwatch()
    columns = [c for c in ("point_id", "x", "w") if c in points.columns]
    points = points.select(*columns)
    with RunTables(spark) as tables:
        with watch.scanning():
            rows = machine_rows(points, machines, uniform)
        n, largest = sum(rows), max(rows, default=0)
        if n == 0:
            raise ValueError("there are no points to cluster")
        stop_at = formulas.sample_prune_subset(k, n, epsilon)
        rank = formulas.tail_rank(n)
        # nothing is near an empty sample
        survivors, remaining = points.withColumn("d2", F.lit(float("inf"))), n
        parts: list[DataFrame] = []
        rounds, comps, comps_per_machine, in_sample = [], 0.0, 0.0, 0
        while (remaining > stop_at or len(rounds) < min_iter) and (max_iter is None or len(rounds) < max_iter):
            round_no, sizes = len(rounds) + 1, dict(s=0, h=0)
            if remaining > 0:
                with watch.scanning():
                    sample, pivots, sizes = draw_round(
                        survivors, k, n, epsilon, remaining, seed, round_no, uniform, tables
                    )
            if sizes["s"] == 0 or sizes["h"] == 0:
                tables.drop(f"drawn-{round_no}")
                if round_no > min_iter:
                    break
                # a round that draws nothing leaves all as it is
                rounds.append(
                    dict(round=round_no, remaining=remaining, p1_rows=0, p2_rows=0, center_count=in_sample, r=rank, v=None,
                         handled=0, handled_risk=0.0, survivors=remaining, alpha=0.0, long_enough=False)
                )
                continue
            parts.append(sample)
            sample, _ = fetched(sample, center_bytes)  # once, for both uses below
            in_sample += sizes["s"]
            v, long_enough = pivot_distance(pivots, sample, rank, tables, center_bytes)
            comps += remaining * sizes["s"]
            comps_per_machine += largest * sizes["s"]
            with watch.scanning():
                scored = nearer_sample(survivors, sample, tables, center_bytes)
                pruned = prune(scored, v, tables, f"survivors-{round_no}", [*columns, "d2"], machines, uniform)
            rounds.append(
                dict(round=round_no, remaining=remaining, p1_rows=sizes["s"], p2_rows=sizes["h"],
                     center_count=in_sample, r=rank, v=v, handled=pruned.handled,
                     handled_risk=float(pruned.handled_risk), survivors=pruned.remaining,
                     alpha=min(1.0, formulas.sample_rate_s(k, n, epsilon, remaining)),
                     long_enough=long_enough)
            )
            if round_no > 1:
                tables.drop(f"survivors-{round_no - 1}")
            survivors, remaining, largest = pruned.survivors, pruned.remaining, pruned.largest
            if pruned.handled == 0 and round_no >= min_iter:
                break

        capped = remaining > stop_at
        if remaining > 0:
            parts.append(survivors.select(F.col("point_id").alias("center_id"), F.col("x").alias("c")))
        everyone = parts[0]
        for part in parts[1:]:
            everyone = everyone.unionByName(part)
        centers = tables.write(everyone, "centers")
        with watch.scanning():
            weighted = tables.write(
                weight_table(points, centers, tables=tables, max_bytes=center_bytes), "weighted"
            )
        totals = weighted.agg(F.sum("cost").alias("cost"), F.count("*").alias("n")).first()
        rows = weighted.where("weight > 0").select(
            F.col("center_id").alias("point_id"), F.col("c").alias("x"), F.col("weight").alias("w")
        )
        final = (reducer or spark_kmeans())(rows, k, seed)
        risk_final = None
        if final_risk:
            with watch.scanning():
                risk_final = risk(points, final, tables=tables)
        kept = None
        if keep_centers:
            kept = RunTables(spark).write(weighted.select("center_id", "c", "weight"), "centers")
    return ClusteringResult(
        "sample_prune", k, final, kept, totals.n, len(rounds) + 1, totals.cost or 0.0, risk_final,
        total_comps=comps, comps_per_machine=comps_per_machine, capacity=stop_at,
        scan_seconds=watch.scan, total_seconds=watch.total(), rounds=rounds, capped=capped,
    )


def draw_round(survivors, k, n, epsilon, remaining, seed, round_no, uniform, tables):
    """(sample to join the centres, sample for the pivot, sizes) of one round."""
    rates = (
        formulas.sample_rate_s(k, n, epsilon, remaining),
        formulas.sample_rate_h(n, epsilon, remaining),
    )
    drawn = two_samples(survivors, rates, ("s", "h"), seed, round_no, uniform)
    table = tables.write(drawn, f"drawn-{round_no}")
    row = table.agg(F.count_if("s").alias("s"), F.count_if("h").alias("h")).first()
    sample = table.where("s").select(F.col("point_id").alias("center_id"), F.col("x").alias("c"))
    return sample, table.where("h").drop("s", "h"), row.asDict()


def nearer_sample(survivors: DataFrame, sample: DataFrame, tables, center_bytes=CENTER_BYTES) -> DataFrame:
    """Survivors with the distance to the sample so far brought up to date."""
    known = survivors.withColumnRenamed("d2", "known")
    scored = with_nearest(known, sample, tables=tables, max_bytes=center_bytes).drop("center_id")
    return closer_of(scored, "known", "d2").drop("known")


def pivot_distance(pivots, sample, rank, tables, center_bytes=CENTER_BYTES) -> tuple[float, bool]:
    """Distance of the rank-th farthest pivot row (the nearest one if there are too few)."""
    return tail_distance(nearer_sample(pivots, sample, tables, center_bytes), rank)
