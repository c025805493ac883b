"""Row draws. All but the top-l draws are narrow filters."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import POINT_ID, uniform
from .selection import exact_cut


def round_salt(name: str, round_no: int) -> str:
    """Salt of a draw: the name alone in the first round, with the round number afterwards."""
    return name if round_no == 1 else f"{name}r{round_no}"


def two_samples(
    points: DataFrame,
    rates: tuple[float, float],
    names: tuple[str, str],
    seed: int,
    round_no: int = 1,
    method: str = "xxhash64",
) -> DataFrame:
    """Rows of two independent draws in one scan, flagged by the two ``names`` columns.

    A row may be in both. Rates above 1 take every row.
    """
    flags = [
        (uniform(points, seed, round_salt(n, round_no), method) < F.lit(min(1.0, float(rate)))).alias(n)
        for n, rate in zip(names, rates)
    ]
    return points.select("*", *flags).where(F.col(names[0]) | F.col(names[1]))


def paired_sample(
    points: DataFrame,
    alpha: float,
    seed: int,
    round_no: int = 1,
    method: str = "xxhash64",
    disjoint: bool = False,
) -> DataFrame:
    """Samples p1 and p2, each a fraction alpha: independent, or two halves of one 2*alpha draw.

    Once 2*alpha reaches 1 the disjoint form splits all rows in half.
    """
    if not disjoint:
        return two_samples(points, (alpha, alpha), ("p1", "p2"), seed, round_no, method)
    half = min(float(alpha), 0.5)
    u = uniform(points, seed, round_salt("p1", round_no), method)
    drawn = points.select("*", u.alias("u")).where(F.col("u") < F.lit(2 * half))
    first = F.col("u") < F.lit(half)
    return drawn.select("*", first.alias("p1"), (~first).alias("p2")).drop("u")


def exact_samples(
    points: DataFrame,
    rates: dict[str, float],
    seed: int,
    round_no: int = 1,
    method: str = "xxhash64",
) -> DataFrame:
    """Independent draws of exactly round(rate * n) rows each, flagged by columns; halves round to even.

    The cut below which so many draws lie is found by counting ranges of the draws, ties by key, over keys alone.
    Needs a unique ``point_id``, as its draws must be the same in every pass.
    """
    if POINT_ID not in points.columns:
        raise ValueError("a sample of exact size needs a unique point_id column")
    n = points.count()
    keys = points.select(POINT_ID)
    flags = []
    for name, rate in rates.items():
        draw = uniform(points, seed, round_salt(name, round_no), method)
        below = exact_cut(keys.withColumn("draw", draw), "draw", round(n * min(1.0, float(rate))), n)
        flags.append((name, draw, below))
    drawn = points
    for name, draw, below in flags:
        drawn = drawn.withColumn("draw", draw).withColumn(name, below).drop("draw")
    return drawn.where(" OR ".join(f"`{name}`" for name in rates))


def lowest(points: DataFrame, order: Column, count: int) -> DataFrame:
    """The ``count`` rows lowest by ``order``, ties by key; each task keeps at most ``count`` rows."""
    tie = [F.col(POINT_ID)] if POINT_ID in points.columns else []
    # a column of its own, so that it is computed once for a row and not in every comparison
    place = f"order_{uuid4().hex}"
    return points.withColumn(place, order).orderBy(place, *tie).limit(count).drop(place)


def random_rows(points: DataFrame, count: int, seed: int, salt: str = "c", method: str = "xxhash64") -> DataFrame:
    """``count`` rows drawn uniformly without replacement."""
    return lowest(points, uniform(points, seed, salt, method), count)


def weighted_draw(
    scored: DataFrame, count: int, seed: int, salt: str, method: str = "xxhash64", d2: str = "d2"
) -> DataFrame:
    """``count`` rows without replacement, the chance of each in proportion to its d2 (times w, if it has one).

    Exponential keys -ln(u)/d2 make this a top-l query: no normalising sum is needed.
    Rows at distance 0 or of weight 0 are never drawn; if fewer rows are left, all of them are.
    """
    chance = F.col(d2) * F.col("w") if "w" in scored.columns else F.col(d2)
    key = -F.ln(uniform(scored, seed, salt, method)) / chance
    return lowest(scored.where(chance > 0), key, count)
