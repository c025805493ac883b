"""Repeated runs, parameter sweeps and comparisons of algorithms."""

from __future__ import annotations

import hashlib
import json
import time
from itertools import groupby
from typing import Callable, Iterable

from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formulas
from .kmeans_parallel import kmeans_parallel
from .result import ClusteringResult
from .sample_prune import sample_prune
from .sampled_kmeans import finish_runs, sampled_kmeans

# The published parameter grid.
ROUNDS = 10
SWEEP_K = [25, 50, 100, 200]
SWEEP_K_IMAGES = [10, 30]
SWEEP_EPSILON = [0.01, 0.05, 0.1, 0.2]
SWEEP_STEPS = [1, 2, 3, 4, 5]
SKIPPED_K, SKIPPED_EPSILON = 200, 0.2

METRICS_SCHEMA = (
    "dataset string, steps int, algorithm string, test_name string, round int, k int, dt double, m int, ep double, l int, num_centers bigint, "
    "iterations int, risk double, risk_final double, coord_mem double, comps_pm double, comps_tot double, "
    "reducers_time double, total_time double"
)


def metrics_row(
    result: ClusteringResult, round_no: int, dt: float, m: int, ep: float, l: int = -1, dataset: str | None = None,
    steps: int | None = None,
) -> tuple:
    """One row of METRICS_SCHEMA; both times are seconds really elapsed."""
    return (
        dataset, steps, result.algorithm, f"{result.algorithm}_round_{round_no}", round_no, result.k, float(dt), m, float(ep), l,
        int(result.candidate_count), result.iterations, float(result.risk), float(result.risk_final),
        float(result.capacity), float(result.comps_per_machine), float(result.total_comps),
        result.scan_seconds, result.total_seconds,
    )


def run_algorithm(
    points: DataFrame, algorithm: str, k: int, epsilon: float, *, delta: float = formulas.DELTA,
    m: int | None = None, steps: int = formulas.INNER_ITERATIONS, seed: int = 1, **options,
) -> ClusteringResult:
    if algorithm == "sampled_kmeans":
        return sampled_kmeans(points, k, epsilon, delta, m=m, seed=seed, **options)
    if algorithm == "kmeans_parallel":
        return kmeans_parallel(points, k, iterations=steps, m=m or 1, seed=seed, **options)
    if algorithm == "sample_prune":
        return sample_prune(points, k, epsilon, seed=seed, machines=m or formulas.MACHINES, **options)
    raise ValueError(f"unknown algorithm {algorithm!r}")


def _metrics_of_round(points, algorithm, k, epsilon, round_no, seed, delta, m, dataset, steps, options) -> tuple:
    own = {} if steps is None else {"steps": steps}
    result = run_algorithm(points, algorithm, k, epsilon, delta=delta, m=m, seed=seed + round_no, **own, **options)
    return metrics_row(result, round_no, delta, m or 1, epsilon, dataset=dataset, steps=steps)


def _metrics(points, algorithm, k, epsilon, rounds, seed, delta, m, dataset, steps, options) -> list[tuple]:
    return [
        _metrics_of_round(points, algorithm, k, epsilon, i, seed, delta, m, dataset, steps, options) for i in range(rounds)
    ]


def repeat_runs(
    points: DataFrame, algorithm: str, k: int, epsilon: float, *, rounds: int = ROUNDS, seed: int = 1,
    delta: float = formulas.DELTA, m: int | None = None, dataset: str | None = None, steps: int | None = None, **options,
) -> DataFrame:
    """Metrics of ``rounds`` runs whose seeds follow each other."""
    rows = _metrics(points, algorithm, k, epsilon, rounds, seed, delta, m, dataset, steps, options)
    return points.sparkSession.createDataFrame(rows, METRICS_SCHEMA)


def repeat_shared(
    points: DataFrame, k: int, epsilon: float, *, rounds: int = ROUNDS, seed: int = 1, delta: float = formulas.DELTA,
    m: int | None = None, dataset: str | None = None, reducer=None, **options,
) -> DataFrame:
    """The rows of ``repeat_runs`` of ``sampled_kmeans``; all runs share the scans that weigh and cost them.

    R runs of r rounds take R (1 + 2 r) + 2 scans instead of R (3 + 2 r); of these only the first three of a run and
    the two at the end read all points. The times of shared scans are dealt out evenly.
    """
    runs = {
        seed + i: sampled_kmeans(points, k, epsilon, delta, m=m, seed=seed + i, reducer=reducer, finish=False, **options)
        for i in range(rounds)
    }
    finished = finish_runs(points, runs, k, reducer=reducer, measure=options.get("measure", "euclidean"))
    rows = [metrics_row(r, s - seed, delta, m or 1, epsilon, dataset=dataset) for s, r in finished.items()]
    return points.sparkSession.createDataFrame(rows, METRICS_SCHEMA)


def best_run(points: DataFrame, algorithm: str, k: int, epsilon: float, seeds: Iterable[int], **options) -> ClusteringResult:
    """The cheapest of the runs with the given seeds."""
    runs = [run_algorithm(points, algorithm, k, epsilon, seed=s, **options) for s in seeds]
    return min(runs, key=lambda r: r.risk_final)


def compare_runs(points: DataFrame, algorithms: Iterable[str], k: int, epsilon: float, **options) -> DataFrame:
    """Metrics of several algorithms over the same points."""
    parts = [repeat_runs(points, a, k, epsilon, **options) for a in algorithms]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _values(items):
    return F.array(*[F.lit(i) for i in items])


def sweep_ks(dataset: Column) -> Column:
    """The k to try: a mixture's own number of clusters, a short list for images, else the grid."""
    own = F.nullif(F.regexp_extract(dataset, "^gaussian_([0-9]+)$", 1), F.lit("")).cast("int")
    return (
        F.when(own.isNotNull(), F.array(own))
        .when(dataset == "mnist", _values(SWEEP_K_IMAGES))
        .otherwise(_values(SWEEP_K))
    )


def sweep_plan(datasets: DataFrame) -> DataFrame:
    """All settings to run for every name in the column dataset.

    The grid is exploded from literals, so each dataset row is expanded where it lies. The
    largest k together with the largest epsilon is left out for sampled_kmeans only.
    """
    by_k = datasets.select("dataset", F.explode(sweep_ks(F.col("dataset"))).alias("k"))
    by_epsilon = by_k.select(
        F.explode(_values(["sampled_kmeans", "sample_prune"])).alias("algorithm"), "dataset", "k"
    ).select("algorithm", "dataset", "k", F.explode(_values(SWEEP_EPSILON)).alias("epsilon"), F.lit(None).cast("int").alias("steps"))
    skipped = (
        (F.col("algorithm") == "sampled_kmeans") & (F.col("k") == SKIPPED_K) & (F.col("epsilon") == SKIPPED_EPSILON)
    )
    by_steps = by_k.select(
        F.lit("kmeans_parallel").alias("algorithm"), "dataset", "k", F.lit(None).cast("double").alias("epsilon"),
        F.explode(_values(SWEEP_STEPS)).alias("steps"),
    )
    return by_epsilon.where(~skipped).unionByName(by_steps)


class SweepResults:
    """Metrics of the runs of a sweep in a folder of Parquet files, one for each run, named by its setting and round.

    A run that is there is not done again, and one that was written twice stands there once. Settings
    are told apart by dataset, algorithm, k, epsilon, steps, delta, m, the round and its seed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [d.getPath().getName() for d in files.listStatus(folder)] if files.exists(folder) else []
        done = [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        self.done = {n.removeprefix("run=") for n in done}

    @staticmethod
    def name(*setting) -> str:
        return hashlib.sha256(json.dumps(setting).encode()).hexdigest()[:32]

    def add(self, name: str, row: tuple) -> None:
        self.spark.createDataFrame([row], METRICS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={name}")
        self.done.add(name)

    def rows(self) -> DataFrame:
        if not self.done:
            return self.spark.createDataFrame([], METRICS_SCHEMA)
        return self.spark.read.schema(METRICS_SCHEMA).parquet(*[f"{self.path}/run={name}" for name in sorted(self.done)])


def run_sweep(
    spark: SparkSession, load: Callable[[str], DataFrame], datasets: DataFrame, *, rounds: int = ROUNDS, seed: int = 1,
    delta: float = formulas.DELTA, m: int | None = None, plan: DataFrame | None = None, results: str | None = None,
    by_algorithm: dict[str, dict] | None = None, **options,
) -> DataFrame:
    """Runs every setting of the sweep plan, or of ``plan``, and returns all metrics.

    The plan is a list for a person to wait for, one clustering per row. Each dataset is loaded and kept
    once for all its settings; a setting without epsilon (k-means||) has 0 there, one without steps none.
    ``options`` go to all algorithms, those of ``by_algorithm`` to the one named. With a folder ``results`` every run
    is written there as it ends, and runs that are there already are left out: a sweep that stopped goes on. The
    metrics returned are then those of the whole folder.
    """
    kept = SweepResults(spark, results) if results else None
    settings = (sweep_plan(datasets) if plan is None else plan).orderBy("dataset", "k", "algorithm", "epsilon", "steps").collect()
    rows: list[tuple] = []
    for dataset, own in groupby(settings, key=lambda s: s.dataset):
        missing = [
            (s, i, name) for s in own for i in range(rounds)
            for name in [SweepResults.name(dataset, s.algorithm, s.k, s.epsilon, s.steps, delta, m, i, seed)]
            if kept is None or name not in kept.done
        ]
        if not missing:
            continue
        points = load(dataset).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for s, i, name in missing:
                given = {**options, **(by_algorithm or {}).get(s.algorithm, {})}
                row = _metrics_of_round(points, s.algorithm, s.k, s.epsilon or 0.0, i, seed, delta, m, dataset, s.steps, given)
                if kept is not None:
                    kept.add(name, row)
                else:
                    rows.append(row)
        finally:
            points.unpersist()
    return kept.rows() if kept is not None else spark.createDataFrame(rows, METRICS_SCHEMA)


def fit_and_evaluate(estimators: dict[str, Estimator], vectors: DataFrame) -> DataFrame:
    """Cost, iterations and elapsed seconds of ML estimators on one table."""
    rows = []
    for name, estimator in estimators.items():
        start = time.perf_counter()
        model = estimator.fit(vectors)
        seconds = time.perf_counter() - start
        summary = model.summary
        rows.append((name, len(model.clusterCenters()), int(summary.numIter), float(summary.trainingCost), seconds))
    return vectors.sparkSession.createDataFrame(
        rows, "estimator string, num_centers int, iterations int, risk_final double, total_time double"
    )
