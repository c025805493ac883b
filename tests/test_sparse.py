import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from brute_force import all_d2
from prunecluster import Centers, PrunedKMeans, sampled_kmeans
from prunecluster.functions import sparse
from prunecluster.functions.sparse import SparseCenters, is_sparse, sparse_finder, sparse_point, sparse_reader
from prunecluster.operators import cost, nearest, prep


@pytest.fixture
def make_sparse(spark):
    def make(matrix, weights=None, partitions=3):
        rows = [(f"p{i:05d}", Vectors.sparse(len(x), [(j, float(v)) for j, v in enumerate(x) if v])) for i, x in enumerate(matrix)]
        df = spark.createDataFrame(rows, ["point_id", "v"]).select("point_id", sparse_point(F.col("v")).alias("x"))
        if weights is not None:
            known = spark.createDataFrame([(f"p{i:05d}", float(w)) for i, w in enumerate(weights)], "point_id string, w double")
            df = df.join(known, "point_id")
        return df.repartition(partitions)

    return make


@pytest.fixture
def thin():
    rng = np.random.default_rng(6)
    return rng.integers(1, 5, (300, 40)) * (rng.random((300, 40)) < 0.1)


def some_rows(matrix, ids=()):
    return SparseCenters.of(Centers(matrix, list(ids)))


def test_equals_the_dense_kernel(make_sparse, make_points, thin):
    dense, points = make_points(thin), make_sparse(thin)
    assert is_sparse(points) and not is_sparse(dense)
    for centers in (Centers(thin[:17]), some_rows(thin[:17]), Centers(np.full((1, 40), 0.5)), Centers(thin[:3], ["a", "b", "c"])):
        rows = {r.point_id: (r.d2, r.center_id) for r in nearest.with_nearest(points, centers).collect()}
        plain = centers.dense() if isinstance(centers, SparseCenters) else centers
        assert rows == {r.point_id: (r.d2, r.center_id) for r in nearest.with_nearest(dense, plain).collect()}


def test_blocks_of_any_size(thin, monkeypatch):
    starts = np.r_[0, np.cumsum((thin != 0).sum(axis=1))]
    where, numbers = np.nonzero(thin)[1], thin[thin != 0].astype(float)
    expected = all_d2(thin, thin[:50])
    for matches, cells in ((1, 1), (7, 60), (1000, 333), (1 << 21, 1 << 21)):
        monkeypatch.setattr(sparse, "MATCHES", matches)
        monkeypatch.setattr(sparse, "CELLS", cells)
        d2, best = sparse_finder(some_rows(thin[:50]))(starts, where, numbers)
        assert np.array_equal(d2, expected.min(axis=1)) and np.array_equal(best, expected.argmin(axis=1))
    d2, best = sparse_finder(some_rows(thin[:5]))(np.zeros(4, np.int64), np.zeros(0, np.int64), np.zeros(0))
    assert np.array_equal(d2, np.repeat((thin[:5] ** 2).sum(axis=1).min(), 3))


def test_cosine(make_sparse, make_points, thin):
    full = thin[(thin != 0).any(axis=1)]
    centers = Centers(full[:9])
    a, b = (
        {r.point_id: (round(r.d2, 12), r.center_id) for r in nearest.with_nearest(make(full), centers, "cosine").collect()}
        for make in (make_sparse, make_points)
    )
    assert {k: v[0] for k, v in a.items()} == pytest.approx({k: v[0] for k, v in b.items()}, abs=1e-9)


def test_parts_of_centres_keep_ties(make_sparse, thin):
    points, centers = make_sparse(thin), some_rows(np.vstack([thin[:20], thin[:20]]))
    whole = {r.point_id: (r.d2, r.center_id) for r in nearest.with_nearest(points, centers).collect()}
    parts = {r.point_id: (r.d2, r.center_id) for r in nearest.with_nearest(points, centers, max_bytes=200).collect()}
    assert whole == parts and max(c for _, c in whole.values()) < 20
    with pytest.raises(ValueError, match="sparse centres"):
        nearest.with_nearest(points, points.select(F.col("point_id").alias("center_id"), F.col("x").alias("c")), max_bytes=100)


def test_costs_and_weights(spark, make_sparse, thin):
    weights = np.arange(len(thin)) % 3
    points, centers = make_sparse(thin, weights), some_rows(thin[:12])
    d2 = all_d2(thin, thin[:12])
    assert cost.risk(points, centers) == (d2.min(axis=1) * weights).sum()
    weighted, total = cost.center_weights(points, centers)
    assert list(weighted.weights) == [int(weights[d2.argmin(axis=1) == i].sum()) for i in range(12)] and total == (d2.min(axis=1) * weights).sum()
    table = {r.center_id: r.weight for r in cost.weight_table(points, centers).collect()}
    assert [table[i] for i in range(12)] == list(weighted.weights)
    assert nearest.predict(points, centers).agg(F.max("prediction")).first()[0] < 12
    found = nearest.with_nearest(points, points.limit(5).select(F.col("point_id").alias("center_id"), F.col("x").alias("c")))
    assert found.count() == len(thin)


def test_no_dense_array(make_sparse):
    wide = np.zeros((5, 30_000))
    wide[np.arange(5), np.arange(5) * 5000 + 7] = 1
    scored = nearest.with_nearest(make_sparse(wide), some_rows(wide[:2]))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "vector_to_array" not in plan and sorted(r.d2 for r in scored.collect()) == [0, 0, 2, 2, 2]
    assert max(r.n for r in scored.select(F.size("x.values").alias("n")).collect()) == 1


def test_one_hot_points(spark):
    rows = [(1, "b", "x", 2.0), (2, "a", None, None), (3, "c", "y", 0.0), (4, None, "x", -1.5)]
    df = spark.createDataFrame(rows, "id long, one string, two string, number double")
    found = prep.one_hot_points(df, [F.col("id")], ["one", "two"], ["number"])
    assert {r.point_id: (r.x.size, r.x.indices, r.x["values"]) for r in found.collect()} == {
        1: (6, [0, 2, 4], [2.0, 1.0, 1.0]), 2: (6, [0, 1], [0.0, 1.0]), 3: (6, [0, 3, 5], [0.0, 1.0, 1.0]), 4: (6, [0, 4], [-1.5, 1.0]),
    }
    assert prep.one_hot_points(df.limit(0), [F.col("id"), F.col("one")], ["one"]).count() == 0


def test_runs_on_sparse_points_come_close_to_dense_ones(make_sparse, make_points):
    rng = np.random.default_rng(8)
    matrix = np.zeros((4000, 30))
    matrix[np.arange(4000), rng.integers(0, 30, 4000)] = rng.integers(1, 50, 4000)
    plain, thin_run = (sampled_kmeans(make(matrix), 3, 0.1, seed=5, max_iter=3) for make in (make_points, make_sparse))
    assert thin_run.risk_final == pytest.approx(plain.risk_final, rel=0.5) and thin_run.centers.dims == 30
    assert len(thin_run.centers) == 3


def test_estimator_takes_sparse_points(make_sparse, thin, tmp_path):
    points = make_sparse(thin[(thin != 0).any(axis=1)]).withColumnRenamed("x", "features")
    for measure in ("euclidean", "cosine"):
        model = PrunedKMeans(k=3, seed=1, idCol="point_id", distanceMeasure=measure).fit(points)
        assert model.transform(points).select("prediction").distinct().count() <= 3
        assert len(model.clusterCenters()[0]) == 40


@pytest.mark.parametrize("row, message", [
    ((5, [0], [1.0]), "coordinates"), ((4, [0, 1], [1.0]), "as many"), ((4, [2, 1], [1.0, 1.0]), "rise"), ((4, [1, 1], [1.0, 1.0]), "rise"),
    ((4, [4], [1.0]), "between"), ((4, [-1], [1.0]), "between"), ((4, [1], [float("nan")]), "finite"), (None, "null"),
])
def test_broken_points_are_refused(row, message):
    kind = pa.struct([("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    good = {"size": 4, "indices": [0, 3], "values": [1.0, 2.0]}
    bad = row and dict(zip(("size", "indices", "values"), row))
    read = sparse_reader(4)
    assert read(pa.array([good, {"size": 4, "indices": [], "values": []}, good], kind))[0].tolist() == [0, 2, 2, 4]
    with pytest.raises(ValueError, match=message):
        read(pa.array([good, bad], kind))


def test_points_meet_their_levels_once(spark):
    rows = [(1, "b", "x", 2.0), (2, "a", None, None), (3, None, "y", 1.0), (3, "b", "x", 2.0), (None, "c", "x", 0.5)]
    df = spark.createDataFrame(rows, "id int, first string, place_0 string, number double")
    points = prep.one_hot_points(df, [F.col("id"), F.col("number") + 1], ["first", "place_0"], ["number"])
    # a pass over the points reads a written table, it joins and moves nothing
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    found = sorted((r.point_id, tuple(r.x.indices), tuple(r.x["values"])) for r in points.collect())
    assert found == [
        ("1.5", (0, 3, 4), (0.5, 1.0, 1.0)), ("1:3.0", (0, 2, 4), (2.0, 1.0, 1.0)), ("2", (0, 1), (0.0, 1.0)),
        ("3:2.0", (0, 5), (1.0, 1.0)), ("3:3.0", (0, 2, 4), (2.0, 1.0, 1.0)),
    ]
