"""Gaussian mixture points with known centres."""

from __future__ import annotations

import hashlib
import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.centers import Centers
from ..functions.formulas import NUMBERS, Primitives
from ..functions.hashing import md5_uniform

# Usual settings of the mixture.
DIMENSIONS = 15
GAMMA = 1.5
STD_DEV = 0.001
SEED = 1234
ROWS = 10_000_000


def mixture_k(name: str) -> int:
    """gaussian_25 -> 25"""
    head, _, count = name.partition("_")
    if head != "gaussian" or not count.isdigit():
        raise ValueError(f"not a mixture name: {name!r}; expected e.g. 'gaussian_25'")
    return int(count)


def cluster_size(n, i, total, gamma: float = GAMMA, on: Primitives = NUMBERS):
    """Rows of cluster i of 1..k, with total the sum of all i^gamma."""
    return on.truncate(n * (on.power(i, gamma) / total))


def size_total(k: int, gamma: float = GAMMA) -> float:
    return sum(math.pow(i, gamma) for i in range(1, k + 1))


def cluster_sizes(n: int, k: int, gamma: float = GAMMA) -> list[int]:
    total = size_total(k, gamma)
    return [cluster_size(n, i, total, gamma) for i in range(1, k + 1)]


def noise(key: Column, dims: int, seed: int) -> list[Column]:
    """Standard normal values, one column per dimension (Box-Muller on hashed uniforms).

    Each md5 digest yields four uniforms, hence four normal values.
    """
    values = []
    for j in range(dims):
        salt, pair, second = f"noise{j // 4}", (j % 4) // 2, j % 2
        radius = F.sqrt(F.lit(-2.0) * F.ln(md5_uniform(key, seed, salt, 2 * pair)))
        angle = F.lit(2 * math.pi) * md5_uniform(key, seed, salt, 2 * pair + 1)
        values.append(radius * (F.sin(angle) if second else F.cos(angle)))
    return values


def mixture_centers(k: int, dims: int = DIMENSIONS, seed: int = SEED) -> Centers:
    """k centres uniform in the unit cube, hashed like the uniform numbers of rows."""
    def coordinate(i, j):
        return (int(hashlib.md5(f"{seed}:center:{i}:{j}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    return Centers([[coordinate(i, j) for j in range(dims)] for i in range(k)])


def place(rows: DataFrame, index: Column, sizes: list[int], centers: Centers, std: float, seed: int) -> DataFrame:
    """(point_id, cluster, x): row ``index`` (0-based) belongs to the cluster whose range holds it.

    Rows beyond the last range are left out.
    """
    upper = list(accumulate(sizes))
    # The ranges are cut at multiples of a stride, so that a row finds its range by an equal key. There
    # are at most ten rows per cluster in this table.
    stride = max(1, upper[-1] // (8 * len(sizes)))
    ranges = [
        (start // stride, start, end, i, [float(v) for v in centers.matrix[i]])
        for i, (size, end) in enumerate(zip(sizes, upper))
        for start in [end - size, *range((end - size) // stride * stride + stride, end, stride)] if size
    ]
    table = rows.sparkSession.createDataFrame(ranges, "part bigint, start bigint, end bigint, cluster int, mean array<double>")
    located = rows.select(index.cast("bigint").alias("point_id")).join(
        F.broadcast(table),
        (F.floor(F.col("point_id") / stride) == F.col("part")) & (F.col("point_id") >= F.col("start")) & (F.col("point_id") < F.col("end")),
    )
    values = noise(F.col("point_id"), centers.dims, seed)
    mean = F.col("mean")
    return located.select(
        "point_id", "cluster", F.array(*[mean[j] + F.lit(std) * v for j, v in enumerate(values)]).alias("x")
    )


def gaussian_points(
    spark: SparkSession,
    k: int,
    n: int = ROWS,
    dims: int = DIMENSIONS,
    gamma: float = GAMMA,
    std: float = STD_DEV,
    seed: int = SEED,
    centers: Centers | None = None,
) -> DataFrame:
    """A mixture of k clusters over about n rows; seed 0 takes a random one."""
    seed = seed or random.randrange(1, 2**31)
    centers = mixture_centers(k, dims, seed) if centers is None else centers
    return place(spark.range(n), F.col("id"), cluster_sizes(n, k, gamma), centers, std, seed)
