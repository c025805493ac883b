import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute_force import all_d2
from prunecluster.functions.centers import Centers
from prunecluster.operators import cost, nearest


def with_distances(spark, values, weights=None):
    rows = [(float(v), 1.0 if weights is None else float(w)) for v, w in zip(values, weights or values)]
    return spark.createDataFrame(rows, "d2 double, w double")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), min_size=1, max_size=25), st.integers(0, 30))
def test_truncated_risk_is_the_sum_of_the_smallest(spark, values, r):
    expected = 0 if r >= len(values) else sum(sorted(values)[: len(values) - r])
    assert cost.truncated_risk(with_distances(spark, values), r) == expected


def test_truncated_risk_with_weights(spark):
    # at the edge value 4 the heavier row is left out
    scored = with_distances(spark, [9, 4, 4, 1], [1, 5, 2, 3])
    assert cost.truncated_risk(scored, 2) == 4 * 2 + 1 * 3


def test_tail_distance(spark):
    scored = with_distances(spark, [5, 3, 3, 8, 1])
    assert cost.tail_distance(scored, 2) == (5.0, True)
    assert cost.tail_distance(scored, 5) == (1.0, True)
    assert cost.tail_distance(scored, 6) == (1.0, False)


def test_costs_of_several_sets_in_one_scan(make_points, lattice_matrix):
    points = make_points(lattice_matrix)
    sets = {"few": Centers(lattice_matrix[:3]), "more": Centers(lattice_matrix[:9])}
    found = cost.costs(points, sets)
    for name, size in (("few", 3), ("more", 9)):
        assert found[name] == all_d2(lattice_matrix, lattice_matrix[:size]).min(axis=1).sum()
    assert found["more"] <= found["few"]
    assert cost.risk(points.where("false"), sets["few"]) == 0.0


def test_weights_are_zero_filled_and_add_up(make_points, lattice_matrix):
    points = make_points(lattice_matrix)
    centers = Centers(np.vstack([lattice_matrix[:6], [[1e6, 1e6, 1e6]]]))
    weighted, total = cost.center_weights(points, centers)
    labels = all_d2(lattice_matrix, centers.matrix).argmin(axis=1)
    assert list(weighted.weights) == [int((labels == i).sum()) for i in range(7)]
    assert weighted.weights.sum() == len(lattice_matrix) and weighted.weights[6] == 0
    assert total == all_d2(lattice_matrix, centers.matrix).min(axis=1).sum()
    rows = {r.center_id: r for r in cost.weight_table(points, centers).collect()}
    assert [rows[i].weight for i in range(7)] == list(weighted.weights)
    assert sum(r.cost for r in rows.values()) == total


def test_instance_weights_of_one_change_nothing(make_points, lattice_matrix):
    plain, ones = make_points(lattice_matrix), make_points(lattice_matrix, np.ones(len(lattice_matrix)))
    centers = Centers(lattice_matrix[:4])
    assert cost.risk(plain, centers) == cost.risk(ones, centers)
    for r in (0, 30, 500):
        a, b = (cost.truncated_risk(nearest.with_nearest(p, centers), r) for p in (plain, ones))
        assert a == b


def test_instance_weights_count(make_points, lattice_matrix):
    weights = np.arange(len(lattice_matrix)) % 4
    points = make_points(lattice_matrix, weights)
    d2 = all_d2(lattice_matrix, lattice_matrix[:4])
    weighted, total = cost.center_weights(points, Centers(lattice_matrix[:4]))
    assert total == (d2.min(axis=1) * weights).sum() == pytest.approx(cost.risk(points, Centers(lattice_matrix[:4])))
    assert weighted.weights.sum() == weights.sum()


def test_machines_by_hash_or_by_partition(spark, make_points, lattice_matrix):
    points = make_points(lattice_matrix)
    dealt = cost.machine_rows(points, 4)
    assert sum(dealt) == len(lattice_matrix) and len(dealt) == 4 and max(dealt) < 140
    assert sorted(dealt) == sorted(cost.machine_rows(points.repartition(7), 4))
    assert sorted(cost.machine_rows(spark.range(100).repartition(4), 4)) == [25] * 4
    assert cost.machine_rows(spark.range(0), 3) == []


def test_hot_centre_is_summed_before_the_exchange(make_points, lattice_matrix):
    plan = cost.weight_table(make_points(lattice_matrix), Centers(lattice_matrix[:4]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in text


def test_sets_in_blocks_share_a_pass(make_points, lattice_matrix):
    points = make_points(lattice_matrix).select("x")
    sets = {"d0": Centers(lattice_matrix[:3]), "d1": Centers(lattice_matrix[:9]), "d2": Centers(lattice_matrix[:30])}
    found = nearest.with_distances(points, sets, max_bytes=100)
    # one Python process for each task, whatever the number of sets
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for r in found.collect():
        for name, centers in sets.items():
            assert r[name] == all_d2([r.x], centers.matrix).min()
