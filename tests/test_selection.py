import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prunecluster.operators import cost, sampling, selection
from prunecluster.operators.selection import select

ANY = st.floats(min_value=0, allow_nan=False, allow_infinity=True)


def table(spark, values, weights=None, partitions=3):
    rows = [(float(v), float(w)) for v, w in zip(values, weights or [1.0] * len(values))]
    return spark.createDataFrame(rows, "d2 double, w double").repartition(partitions)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ANY, min_size=1, max_size=30), st.data())
def test_any_doubles(spark, values, data):
    rank = data.draw(st.integers(1, len(values) + 2))
    cut = select(table(spark, values), "d2", rank)
    if rank > len(values):
        assert cut is None
        return
    value = sorted(values, reverse=True)[rank - 1]
    assert cut.value == value
    assert (cut.above, cut.equal, cut.below) == tuple(
        sum(test) for test in ([v > value for v in values], [v == value for v in values], [v < value for v in values])
    )


@pytest.mark.parametrize("values", [
    [0.0, 5e-324, 1e-323, 2.2e-308, 1.7976931348623157e308, float("inf")], [1 + i * 2.0**-52 for i in range(9)], [0.0] * 7, [3.0] * 9,
    [2.0**i for i in range(-40, 40)], [i * 1e-300 for i in range(30)],
])
def test_every_rank(spark, values):
    df = table(spark, values * 2).persist()
    falling = sorted(values * 2, reverse=True)
    for rank in random.Random(1).sample(range(1, len(falling) + 1), 6):
        assert select(df, "d2", rank).value == falling[rank - 1]
    df.unpersist()


def test_sums_on_each_side(spark):
    rng = np.random.default_rng(2)
    values, weights = rng.integers(0, 2000, 5000).tolist(), rng.integers(1, 9, 5000).tolist()
    cut = select(table(spark, values, weights), "d2", 1234, {"w": F.col("w")})
    side = [[w for v, w in zip(values, weights) if test(v)] for test in (lambda v: v > cut.value, lambda v: v == cut.value, lambda v: v < cut.value)]
    assert [cut.sums_above["w"], cut.sums_equal["w"], cut.sums_below["w"]] == [sum(s) for s in side]
    assert [cut.above, cut.equal, cut.below] == [len(s) for s in side]


def test_few_passes_and_no_sort(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = table(spark, rng.gamma(2.0, 30.0, 20_000))
    seen = []
    group = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: seen.append(self) or group(self, *c))
    select(df, "d2", 10_000)
    assert len(seen) <= 3
    monkeypatch.undo()
    plan = df.groupBy((F.col("d2") / 2).cast("int")).count()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


def test_truncated_risk_at_any_rank_and_weight(spark):
    rng = np.random.default_rng(4)
    values, weights = rng.integers(0, 30, 400).tolist(), rng.integers(0, 5, 400).tolist()
    ordered = sorted(zip(values, weights), reverse=True)
    scored = table(spark, values, weights).persist()
    for r in (0, 1, 57, 200, 399, 400, 401):
        assert cost.truncated_risk(scored, r) == sum(v * w for v, w in ordered[r:])
        plain = sorted(values, reverse=True)[r:]
        assert cost.truncated_risk(scored.drop("w"), r) == sum(plain)
    scored.unpersist()


def test_empty_and_wrong(spark):
    assert select(spark.createDataFrame([], "d2 double, w double"), "d2", 1) is None
    with pytest.raises(ValueError):
        select(table(spark, [1.0]), "d2", 0)


def test_exact_samples(spark):
    points = spark.range(1, 2002).select(F.col("id").alias("point_id"), F.array(F.col("id").cast("double")).alias("x"))
    for method in ("md5", "xxhash64"):
        drawn = sampling.exact_samples(points, {"p1": 0.25, "p2": 0.1}, 3, method=method).collect()
        # 500.25 and 200.1 rows
        assert sum(r.p1 for r in drawn) == 500 and sum(r.p2 for r in drawn) == 200
        again = sampling.exact_samples(points.repartition(7), {"p1": 0.25, "p2": 0.1}, 3, method=method).collect()
        assert {(r.point_id, r.p1, r.p2) for r in drawn} == {(r.point_id, r.p1, r.p2) for r in again}
    whole = sampling.exact_samples(points, {"all": 2.0, "none": 0.0}, 1).collect()
    assert len(whole) == 2001 and all(r["all"] and not r["none"] for r in whole)
    with pytest.raises(ValueError, match="point_id"):
        sampling.exact_samples(points.drop("point_id"), {"p1": 0.1}, 1)


def test_ties_of_the_draw_go_by_key(spark):
    points = spark.range(100).select(F.col("id").alias("point_id"), (F.col("id") % 4).cast("double").alias("draw"))
    for count in (0, 1, 24, 25, 26, 60, 100, 120):
        kept = points.where(selection.exact_cut(points, "draw", count, 100)).collect()
        expected = sorted((r.draw, r.point_id) for r in points.collect())[:count]
        assert sorted((r.draw, r.point_id) for r in kept) == expected
