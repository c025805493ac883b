"""The rank-th largest value of a column, found by counting ranges.

The first aggregate counts rows, and sums what is asked for, in ranges between powers of two; the one that holds the
rank is then cut into equal ranges between its own least and greatest value, again and again until it holds one
value. A pass cuts a range to a part in 32,768, so two or three passes do for any number of rows and any rank.
What lies above and below is summed by the same aggregates. Only ranges with their counts reach the driver,
never rows, and no row is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import POINT_ID

#: Ranges of a pass.
RANGES = 32_768
#: Ranges of the first pass for each power of two; a double spans 2,098 of these.
PER_OCTAVE = 8


@dataclass(frozen=True)
class Cut:
    """The value at a rank; rows and sums above it, at it and below it."""

    value: float
    above: int
    equal: int
    below: int
    sums_above: dict[str, float]
    sums_equal: dict[str, float]
    sums_below: dict[str, float]


def select(df: DataFrame, value: str, rank: int, sums: dict[str, Column] | None = None) -> Cut | None:
    """The ``rank``-th largest ``value`` (rank from 1; none negative or NaN); None if there are fewer rows.

    ``sums`` names what to add up over the rows above, at and below the value.
    """
    if rank < 1:
        raise ValueError("ranks begin at 1")
    sums = sums or {}
    x = F.col(value).cast("double")
    octave = F.floor(F.log2(x) * PER_OCTAVE).cast("bigint")
    key = F.when(x == 0, F.lit(-(1 << 40))).when(x == float("inf"), F.lit(1 << 40)).otherwise(octave)
    inside = df
    above, below = 0, 0
    up = dict.fromkeys(sums, 0.0)
    down = dict.fromkeys(sums, 0.0)
    while True:
        totals = [F.sum(c).alias(f"sum {name}") for name, c in sums.items()]
        ranges = inside.groupBy(key.alias("range")).agg(
            F.count("*").alias("rows"), F.min(x).alias("low"), F.max(x).alias("high"), *totals
        ).collect()
        ranges.sort(key=lambda r: r.range, reverse=True)
        if above + sum(r.rows for r in ranges) < rank:
            return None
        found = None
        for r in ranges:
            if found is not None:
                below += r.rows
            elif above + r.rows < rank:
                above += r.rows
            else:
                found = r
                continue
            for name in sums:
                side = up if found is None else down
                side[name] += r[f"sum {name}"] or 0.0
        if found.low == found.high:
            at = {name: found[f"sum {name}"] or 0.0 for name in sums}
            return Cut(found.low, above, found.rows, below, up, at, down)
        low, high = found.low, found.high
        inside = df.where((x >= F.lit(low)) & (x <= F.lit(high)))
        # Rises with x, as each step of it does. Halves, as the width of the widest range is beyond a double;
        # where they are too small to tell apart, the greatest value has a range of its own all the same.
        width = high / 2 - low / 2
        place = F.least(F.floor((x / 2 - F.lit(low / 2)) / F.lit(width) * RANGES), F.lit(RANGES - 1)) if width > 0 else F.lit(0)
        key = F.when(x == F.lit(high), F.lit(RANGES)).otherwise(place.cast("int"))


def exact_cut(points: DataFrame, draw: str, count: int, rows: int, key: str = POINT_ID) -> Column:
    """A condition that holds for the ``count`` of ``rows`` rows lowest by ``draw``, ties by ``key``, which is unique."""
    if count <= 0:
        return F.lit(False)
    if count >= rows:
        return F.lit(True)
    cut = select(points, draw, rows - count + 1)
    missing = count - cut.below
    if missing == cut.equal:
        return F.col(draw) <= F.lit(cut.value)
    # few rows share one draw
    tied = points.where(F.col(draw) == F.lit(cut.value)).select(key).orderBy(key).limit(missing)
    last = tied.agg(F.max(key)).first()[0]
    return (F.col(draw) < F.lit(cut.value)) | ((F.col(draw) == F.lit(cut.value)) & (F.col(key) <= F.lit(last)))
