"""The clustering used inside the rounds and for the final reduction.

A black box is a function (points, k, seed) -> Centers. The points may carry a weight
column w.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions.centers import Centers
from ..functions.sparse import is_sparse, ml_vector
from ..operators.cost import weight_of

BlackBox = Callable[[DataFrame, int, int], Centers]

# Lloyd steps of the clusterings inside a run; more hardly lower the cost of a small sample.
INNER_MAX_ITER = 10


def spark_kmeans(
    max_iter: int = INNER_MAX_ITER,
    tol: float = 1e-4,
    init_mode: str = "k-means||",
    init_steps: int = 2,
    measure: str = "euclidean",
) -> BlackBox:
    """Spark's own distributed KMeans. It may return fewer than k centres if points coincide."""

    def cluster(points: DataFrame, k: int, seed: int) -> Centers:
        features = ml_vector("x") if is_sparse(points) else array_to_vector("x")
        vectors = points.select(features.alias("features"), weight_of(points).alias("w"))
        if k == 1:
            mean = vectors.select(Summarizer.mean(F.col("features"), F.col("w")).alias("mean")).first().mean
            return Centers(mean.toArray().reshape(1, -1))
        estimator = KMeans(
            k=k, seed=seed, maxIter=max_iter, tol=tol, initMode=init_mode, initSteps=init_steps,
            distanceMeasure=measure, weightCol="w",
        )
        vectors = vectors.persist()
        try:
            return Centers(np.array(estimator.fit(vectors).clusterCenters()))
        finally:
            vectors.unpersist()

    return cluster


def parallel_kmeans(
    iterations: int = formulas.INNER_ITERATIONS, draws: int | None = None, reducer: BlackBox | None = None
) -> BlackBox:
    """k-means|| as black box; the reduction at its end is always a weighted k-means."""
    from .kmeans_parallel import kmeans_parallel

    def cluster(points: DataFrame, k: int, seed: int) -> Centers:
        result = kmeans_parallel(
            points, k, draws=draws, iterations=iterations, seed=seed, reducer=reducer, final_risk=False
        )
        return result.centers

    return cluster


def named_blackbox(
    choice: str | BlackBox, k: int, distributed: BlackBox, l_ratio: float = formulas.INNER_L_TO_K_RATIO
) -> tuple[BlackBox, int]:
    """(black box, row count up to which the last survivors are centres themselves)."""
    if callable(choice):
        return choice, k
    if choice == "kmeans":
        return distributed, k
    if choice == "kmeans_parallel":
        draws = formulas.draws_per_step(k, l_ratio)
        return parallel_kmeans(draws=draws, reducer=distributed), max(k, draws)
    raise ValueError(f"unknown black box {choice!r}; use 'kmeans', 'kmeans_parallel' or a function")


def reduce_centers(spark, candidates: Centers, k: int, seed: int, reducer: BlackBox) -> Centers:
    """Weighted clustering of the candidates to k; those without points do not take part."""
    served = candidates.weights > 0
    kept = Centers(candidates.matrix[served], weights=candidates.weights[served])
    if len(kept) <= k:
        return Centers(kept.matrix)
    rows = kept.to_df(spark).select(F.col("center_id").alias("point_id"), F.col("c").alias("x"), F.col("weight").alias("w"))
    # a few thousand rows at most: one partition spares every k-means step an exchange of crumbs
    return reducer(rows.coalesce(1), k, seed)
