import numpy as np
import pytest
from pyspark.sql import functions as F

from brute_force import all_d2
from prunecluster.functions.centers import Centers
from prunecluster.functions.distance import nearest_finder, squared_distance
from prunecluster.operators import cost, nearest
from prunecluster.storage import RunTables


def collected(df):
    return {r.point_id: (r.d2, r.center_id) for r in df.collect()}


@pytest.mark.parametrize("count", [1, 5, 40])
def test_lattice_matches_brute_force(make_points, lattice_matrix, count):
    centers = lattice_matrix[:count]
    found = collected(nearest.with_nearest(make_points(lattice_matrix), Centers(centers)))
    d2 = all_d2(lattice_matrix, centers)
    for i, row in enumerate(d2):
        assert found[f"p{i:05d}"] == (row.min(), int(row.argmin()))


def test_many_dimensions_are_screened_exactly(make_points):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(300, 40)) + 1000.0
    centers = np.vstack([matrix[:30], matrix[:5]])  # five centres twice: the lower id has to win
    found = collected(nearest.with_nearest(make_points(matrix), Centers(centers)))
    for i, x in enumerate(matrix):
        exact = np.zeros(len(centers))
        for j in range(40):
            gap = x[j] - centers[:, j]
            exact += gap * gap
        assert found[f"p{i:05d}"] == (exact.min(), int(exact.argmin()))


@pytest.mark.parametrize("dims,lattice", [(3, True), (2, False), (12, False)])
def test_many_centres_in_boxes_are_exact(make_points, dims, lattice):
    rng = np.random.default_rng(dims)
    matrix = rng.integers(0, 12, size=(900, dims)).astype(float) if lattice else rng.normal(size=(900, dims)) * 50
    matrix[:5] += 4000  # some far from everything
    centers = np.vstack([matrix[200:], matrix[200:300]])
    found = collected(nearest.with_nearest(make_points(matrix, partitions=2), Centers(centers)))
    exact = np.zeros((len(matrix), len(centers)))
    for j in range(dims):
        gap = matrix[:, j : j + 1] - centers[:, j]
        exact += gap * gap
    assert found == {f"p{i:05d}": (d.min(), int(d.argmin())) for i, d in enumerate(exact)}


def test_ties_go_to_the_lowest_id(make_points):
    points = make_points([[1.0, 0.0]])
    assert collected(nearest.with_nearest(points, Centers([[0.0, 0.0], [2.0, 0.0]])))["p00000"] == (1.0, 0)


def test_blocks_give_the_same_result(spark, make_points, lattice_matrix):
    points = make_points(lattice_matrix)
    centers = Centers(lattice_matrix[:90])
    whole = collected(nearest.with_nearest(points, centers))
    with RunTables(spark) as tables:
        blocks = collected(nearest.with_nearest(points, centers, tables=tables, max_bytes=800))
        table = centers.to_df(spark)
        from_table = collected(nearest.with_nearest(points, table, tables=tables, max_bytes=800))
        assert collected(nearest.with_nearest(points, table)) == whole
    assert blocks == whole and from_table == whole


def test_large_centre_sets_need_nothing_else(spark, make_points, lattice_matrix):
    points, centers = make_points(lattice_matrix), Centers(lattice_matrix)
    small = collected(nearest.with_nearest(points, centers))
    assert collected(nearest.with_nearest(points, centers, max_bytes=100)) == small
    named = Centers(lattice_matrix[:50], [f"c{i:03d}" for i in range(50)])
    found = nearest.with_nearest(points, named, max_bytes=200).select("point_id", "center_id")
    want = nearest.with_nearest(points, named).select("point_id", "center_id")
    assert sorted(found.collect()) == sorted(want.collect())
    assert named.nbytes == 50 * (3 * 8 + 4)


def test_more_centres_than_a_task_should_carry(spark, make_points):
    """70 MB of centres: weights, costs and predictions go through the same path."""
    wide = np.random.default_rng(0).random((2200, 4000))
    centers, points = Centers(wide), make_points(wide[:30], partitions=2)
    assert centers.nbytes > 64 * 1024 * 1024
    weighted, total = cost.center_weights(points, centers)
    assert weighted.weights[:30].tolist() == [1.0] * 30 and weighted.weights.sum() == 30 and total == 0.0
    assert cost.risk(points, centers) == 0.0
    found = nearest.predict(points, centers, "row")
    assert sorted((r.point_id, r.row) for r in found.select("point_id", "row").collect()) == [(f"p{i:05d}", i) for i in range(30)]


@pytest.mark.parametrize("rows", [[[1.0, 2.0, 3.0], [1.0] * 5], [None, [1.0] * 8], [[1.0, 2.0, 3.0, None]], [None]])
@pytest.mark.parametrize("max_bytes", [1 << 20, 40])
def test_ragged_and_null_points_raise(spark, rows, max_bytes):
    points = spark.createDataFrame([(x,) for x in rows], "x array<double>").coalesce(1)
    with pytest.raises(Exception, match="coordinates"):
        nearest.with_nearest(points, Centers([[0.0] * 4, [9.0] * 4]), max_bytes=max_bytes).collect()



def test_string_ids(make_points, lattice_matrix):
    centers = Centers(lattice_matrix[:3], ["a", "b", "c"])
    found = collected(nearest.with_nearest(make_points(lattice_matrix), centers))
    assert {c for _, c in found.values()} <= {"a", "b", "c"}


def test_cosine(make_points, lattice_matrix):
    matrix = lattice_matrix + 1
    centers = matrix[:6]
    found = collected(nearest.with_nearest(make_points(matrix), Centers(centers), "cosine"))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit(matrix) @ unit(centers).T
    for i, row in enumerate(d):
        distance, center = found[f"p{i:05d}"]
        assert distance == pytest.approx(row.min(), abs=1e-12) and row[center] == pytest.approx(row.min(), abs=1e-12)


def test_errors(make_points):
    points = make_points([[1.0, 2.0]])
    with pytest.raises(ValueError):
        nearest.with_nearest(points, Centers([[0.0, 0.0]]), "manhattan")
    for bad in (Centers([[0.0, 0.0, 0.0]]),):
        with pytest.raises(Exception, match="coordinates"):
            nearest.with_nearest(points, bad).collect()
    with pytest.raises(Exception, match="finite"):
        nearest.with_nearest(make_points([[float("nan"), 1.0]]), Centers([[0.0, 0.0]])).collect()


def test_running_minimum_and_predict(make_points, lattice_matrix):
    points, centers = make_points(lattice_matrix), lattice_matrix[:9]
    first = nearest.with_nearest(points, Centers(centers[:4])).drop("center_id").withColumnRenamed("d2", "known")
    both = nearest.closer_of(nearest.with_nearest(first, Centers(centers[4:])), "known", "d2")
    d2 = all_d2(lattice_matrix, centers)
    assert {r.point_id: r.d2 for r in both.collect()} == {f"p{i:05d}": v for i, v in enumerate(d2.min(axis=1))}
    labels = {r.point_id: r.prediction for r in nearest.predict(points, Centers(centers)).collect()}
    assert labels == {f"p{i:05d}": int(v) for i, v in enumerate(d2.argmin(axis=1))}


def test_expression_for_one_centre(make_points, lattice_matrix):
    found = make_points(lattice_matrix).select("point_id", squared_distance(F.col("x"), lattice_matrix[0]).alias("d"))
    d2 = all_d2(lattice_matrix, lattice_matrix[:1])[:, 0]
    assert {r.point_id: r.d for r in found.collect()} == {f"p{i:05d}": v for i, v in enumerate(d2)}


def test_plans_measure_once_and_join_nothing(make_points, lattice_matrix):
    scored = nearest.with_nearest(make_points(lattice_matrix), Centers(lattice_matrix[:5]))
    for df in (scored.where("d2 > 10"), scored.groupBy("center_id").count(), scored.where("center_id = 1 and d2 > 3")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1
        assert "Join" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("dims", [4, 64])
def test_blocks_in_space_equal_brute_force(spark, make_points, dims):
    rng = np.random.default_rng(dims)
    matrix = rng.integers(0, 9, (600, dims)).astype(float)
    matrix[:50] *= 100
    points, centers = make_points(matrix), Centers(np.vstack([matrix[300:], matrix[300:320]]))
    d2 = np.array([((matrix - c) ** 2).sum(axis=1) for c in centers.matrix]).T
    with RunTables(spark) as tables:
        blocks = collected(nearest.with_nearest(points, centers, tables=tables, max_bytes=40 * 8 * dims))
    assert blocks == {f"p{i:05d}": (d.min(), int(d.argmin())) for i, d in enumerate(d2)}


def test_far_blocks_are_not_measured(spark, make_points, monkeypatch):
    """Counted in this process: points and blocks far apart meet in their own blocks only."""
    rng = np.random.default_rng(1)
    corners = np.repeat(np.array([[0.0, 0.0], [1e4, 0.0], [0.0, 1e4], [1e4, 1e4]]), 50, axis=0)
    matrix = corners + rng.integers(0, 20, corners.shape)
    centers = Centers(matrix).to_df(spark)
    chosen = centers.select("center_id", nearest._place(centers).alias("place"))
    places = {}
    for r in chosen.collect():
        places.setdefault(r.center_id // 50, set()).add(r.place)
    spans = sorted((min(p), max(p)) for p in places.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # each corner is a stretch of its own


def test_work_hardly_grows_with_the_number_of_centres():
    import time

    rng = np.random.default_rng(11)
    points = rng.normal(size=(10_000, 4))
    centers = rng.normal(size=(60_000, 4))
    seconds = {}
    for k in (15_000, 60_000):
        find = nearest_finder(centers[:k])
        find(points[:10])
        seconds[k] = min(_timed(time.process_time, lambda: find(points)) for _ in range(3))
    assert seconds[60_000] < 2.8 * seconds[15_000]
    d2, where = find(points[:300])
    every = all_d2(points[:300], centers)
    assert (where == every.argmin(axis=1)).all() and np.allclose(d2, every.min(axis=1), rtol=1e-12)


def _timed(clock, work):
    start = clock()
    work()
    return clock() - start


@pytest.mark.parametrize("dims", [1, 4, 9, 40])
def test_boxes_give_the_first_of_equal_centres(dims):
    rng = np.random.default_rng(12)
    for k in (512, 700, 5000):
        centers, points = rng.integers(0, 12, (k, dims)).astype(float), rng.integers(0, 14, (600, dims)).astype(float)
        d2, where = nearest_finder(centers)(points)
        every = all_d2(points, centers)
        assert (where == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all()
