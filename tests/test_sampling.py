import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prunecluster.functions.hashing import md5_uniform, uniform
from prunecluster.operators import sampling


def test_md5_uniform_matches_hashlib(make_points):
    points = make_points(np.zeros((20, 2)))
    for row in points.select("point_id", md5_uniform(F.col("point_id"), 7, "p1").alias("u")).collect():
        h = int(hashlib.md5(f"7:p1:{row.point_id}".encode()).hexdigest()[:8], 16)
        assert row.u == (h + 0.5) / 2**32


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_uniforms_are_spread_and_independent(make_points, method):
    points = make_points(np.zeros((4000, 1)))
    rows = points.select(uniform(points, 1, "a", method).alias("a"), uniform(points, 1, "b", method).alias("b")).collect()
    a, b = np.array([r.a for r in rows]), np.array([r.b for r in rows])
    assert 0 < a.min() and a.max() < 1
    assert abs(a.mean() - 0.5) < 0.03 and abs(np.corrcoef(a, b)[0, 1]) < 0.06


def test_unknown_method(make_points):
    with pytest.raises(ValueError):
        uniform(make_points(np.zeros((2, 1))), 1, "a", "rand")


@pytest.mark.parametrize("disjoint", [False, True])
def test_paired_sample_does_not_depend_on_partitions(make_points, disjoint):
    matrix = np.arange(900).reshape(-1, 1)
    seen = set()
    for partitions in (1, 4, 7):
        drawn = sampling.paired_sample(make_points(matrix, partitions=partitions), 0.2, 5, disjoint=disjoint)
        seen.add(frozenset((r.point_id, r.p1, r.p2) for r in drawn.collect()))
    assert len(seen) == 1
    rows = next(iter(seen))
    assert 100 < sum(p1 for _, p1, _ in rows) < 260
    if disjoint:
        assert not any(p1 and p2 for _, p1, p2 in rows)


def test_disjoint_halves_take_every_row_at_high_rates(make_points):
    drawn = sampling.paired_sample(make_points(np.zeros((300, 1))), 0.8, 5, disjoint=True).collect()
    assert len(drawn) == 300 and all(r.p1 != r.p2 for r in drawn)


def test_rates_above_one_take_every_row(make_points):
    drawn = sampling.two_samples(make_points(np.zeros((50, 1))), (3.0, 0.1), ("s", "h"), 5)
    assert drawn.where("s").count() == 50


def test_rounds_have_their_own_salt(make_points):
    points = make_points(np.zeros((500, 1)))
    first, second = (
        {r.point_id for r in sampling.paired_sample(points, 0.2, 5, round_no=i).where("p1").collect()} for i in (1, 2)
    )
    assert first != second and sampling.round_salt("p1", 1) == "p1" and sampling.round_salt("p1", 3) == "p1r3"


def test_weighted_draw_takes_exactly_l_and_never_distance_zero(make_points):
    points = make_points(np.zeros((60, 1))).withColumn("d2", F.when(F.col("point_id") < "p00012", 3.0).otherwise(0.0))
    assert sampling.weighted_draw(points, 5, 1, "d").count() == 5
    everyone = sampling.weighted_draw(points, 50, 1, "d").collect()
    assert len(everyone) == 12 and all(r.d2 > 0 for r in everyone)


def test_weighted_draw_prefers_far_rows(make_points):
    # one row holds half of the total weight: its share of single draws has to be near one half
    points = make_points(np.zeros((101, 1))).withColumn("d2", F.when(F.col("point_id") == "p00000", 100.0).otherwise(1.0))
    hits = sum(sampling.weighted_draw(points, 1, seed, "d").first().point_id == "p00000" for seed in range(40))
    assert 10 <= hits <= 30


def test_rand_fallback_without_ids(spark):
    points = spark.range(1000).select(F.array(F.col("id").cast("double")).alias("x"))
    drawn = sampling.paired_sample(points, 0.3, 9)
    assert 200 < drawn.where("p1").count() < 400
    assert drawn.collect() == drawn.collect()


def test_the_order_of_a_draw_is_computed_once_for_a_row(make_points):
    points = make_points([[float(i)] for i in range(50)])
    scored = points.withColumn("d2", F.lit(2.0))
    for drawn in (sampling.random_rows(points, 5, 1, method="md5"), sampling.weighted_draw(scored, 5, 1, "d", "md5")):
        plan = drawn._jdf.queryExecution().executedPlan().toString()
        order = re.search(r"TakeOrderedAndProject\(limit=5, orderBy=\[([^\]]*)", plan).group(1)
        assert "md5" not in order and "md5" in plan
        assert drawn.count() == 5 and set(drawn.columns) <= {"point_id", "x", "d2"}
