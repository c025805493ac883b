import csv
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from prunecluster.operators import prep
from prunecluster.plans import evaluate
from prunecluster.sources import gaussians, points, sinks
from prunecluster.storage import RunTables, shared_folder


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_with_inferred_types(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["id,name,size", "1,x,2.5", "2,y,", "3,z,4.0"])
    assert [tuple(r) for r in points.read_csv_points(spark, path).orderBy("id").collect()] == [(1, 2.5), (3, 4.0)]
    kept = points.read_csv_points(spark, path, preparation=points.Preparation(drop_nulls=False))
    assert kept.count() == 3


def test_csv_without_header_and_with_a_limit(spark, tmp_path):
    path = write(tmp_path / "b.csv", [f"{i},{i * 2}" for i in range(10)])
    df = points.read_csv_points(spark, path, header=False, schema="a int, b int", limit=4, order=["a"])
    assert [r.a for r in df.collect()] == [0, 1, 2, 3]
    assert sorted(r._c0 for r in points.read_csv_points(spark, path, header=False, limit=4).collect()) == [0, 1, 2, 3]
    assert [r.a for r in points.read_csv_points(spark, path, schema="a int, b int", skip_lines=3, limit=4, order=["a"]).collect()] == [4, 5, 6, 7]


def test_malformed_rows_can_be_skipped(spark, tmp_path):
    path = write(tmp_path / "c.csv", ["1,2", "oops,3", "4,5"])
    df = points.read_csv_points(spark, path, header=False, schema="a int, b int", skip_malformed=True)
    assert df.select("a", "b").collect() == [(1, 2), (4, 5)]


def test_presets(spark, tmp_path):
    path = write(tmp_path / "d.csv", ["id,color,size", "7,red,1", "8,blue,2", "9,,3"])
    census = points.read_preset(spark, "census1990", path)
    assert census.columns == ["size", "color_blue", "color_red"]
    assert sorted(map(tuple, census.collect())) == [(1, 0, 1), (2, 1, 0), (3, 0, 0)]
    assert points.read_preset(spark, "kdd", path).columns == ["id", "size"]
    with pytest.raises(ValueError):
        points.preset("iris")


def test_libsvm(spark, tmp_path):
    path = write(tmp_path / "e.txt", ["1 1:0.5 3:2.0", "0 2:1.0"])
    rows = points.read_libsvm_points(spark, path, dims=3).orderBy("label").collect()
    assert [(r.label, r.x) for r in rows] == [(0.0, [0.0, 1.0, 0.0]), (1.0, [0.5, 0.0, 2.0])]


def test_to_points(spark):
    df = spark.createDataFrame([(1, 2, 3.0, None), (4, 5, 6.0, 2.0)], "a int, b int, c double, w double")
    rows = points.to_points(df, ["b", "c"], ["a", "b"], "w").orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.w) for r in rows] == [("1:2", [2.0, 3.0], 1.0), ("4:5", [5.0, 6.0], 2.0)]


def test_prepare_edges(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, None, float("nan"))], "id int, s string, v double")
    assert prep.one_hot(df).columns == ["id", "v", "s_a"]
    assert prep.drop_nulls(df).count() == 2
    scaled = prep.min_max_scale(df.where("id < 3"), ["id", "v"]).orderBy("id").collect()
    assert [(r.id, r.v) for r in scaled] == [(0.0, 0.0), (1.0, 0.0)]
    numeric = prep.numeric_projection(df)
    assert numeric.columns == ["id", "v"]
    stages = {r.stage: r for r in prep.profile({"raw": df, "numeric": numeric}).collect()}
    assert stages["raw"].column_types == "integer,string,double" and stages["numeric"].row_count == 3
    grid = spark.createDataFrame([([[255, 0], [51, 102]],)], "g array<array<int>>")
    assert grid.select(prep.constant_scale(F.col("g")).alias("x")).first().x == [1.0, 0.0, 0.2, 0.4]


def test_any_number_of_levels(spark):
    df = spark.range(10_001).select("id", F.format_string("v%05d", "id").alias("s"))
    assert len(prep.one_hot(df).columns) == 10_002
    named = prep.one_hot(df, levels={"s": ["v00003"]})
    assert named.columns == ["id", "s_v00003"] and named.agg(F.sum("s_v00003")).first()[0] == 1
    some = df.union(spark.createDataFrame([(7, None), (8, "v00003")], "id long, s string")).repartition(5)
    rows = prep.one_hot_sparse(some, "s").collect()
    assert sorted((r.id, -1 if r.s_index is None else r.s_index) for r in rows) == sorted([(i, i) for i in range(10_001)] + [(7, -1), (8, 3)])


def test_row_limit_is_exact(spark):
    df = spark.range(1000).repartition(7).select("id", (F.col("id") % 10).alias("g"))
    rows = prep.first_rows(df, 137, ["g", "id"]).collect()
    assert sorted((r.g, r.id) for r in rows) == sorted((i % 10, i) for i in range(1000))[:137]
    assert prep.first_rows(df, 5000, ["id"]).count() == 1000 and prep.first_rows(df.limit(0), 5, ["id"]).count() == 0


def test_nan_has_no_part_in_a_range(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, float("nan")), (float("nan"), 5.0)], "a double, b double")
    rows = [(r.a, r.b) for r in prep.min_max_scale(df, ["a", "b"]).collect()]
    assert str(rows) == "[(0.0, 0.0), (1.0, nan), (nan, 0.0)]"
    with pytest.raises(Exception, match="weight"):
        df.select(prep.checked_weight(F.col("b"))).collect()


def test_datasets_by_name(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, "x"), (2, None, "y")], "a int, b double, c string").write.option("header", True).csv(f"{tmp_path}/t")
    assert points.load_dataset(spark, f"{tmp_path}/t").columns == ["a", "b"]
    assert points.load_dataset(spark, "kdd", f"{tmp_path}/t").count() == 2
    assert points.load_dataset(spark, "gaussian_3", n=100, dims=2).select("cluster").distinct().count() == 3
    with pytest.raises(ValueError):
        points.load_dataset(spark, "kdd")


def test_spread_leaves_split_tables_alone(spark):
    wide = spark.range(100).repartition(16)
    assert prep.spread(wide) is wide
    assert prep.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 8


def test_gaussian_sizes_and_points(spark):
    sizes = gaussians.cluster_sizes(1000, 4)
    total = sum(i**1.5 for i in range(1, 5))
    assert sizes == [math.floor(1000 * i**1.5 / total) for i in range(1, 5)]
    made = gaussians.gaussian_points(spark, 4, n=1000, dims=5, std=0.01, seed=3)
    rows = made.collect()
    assert len(rows) == sum(sizes)
    centers = gaussians.mixture_centers(4, 5, 3).matrix
    for cluster, size in enumerate(sizes):
        mine = np.array([r.x for r in rows if r.cluster == cluster])
        assert len(mine) == size
        noise = (mine - centers[cluster]) / 0.01
        assert abs(noise.mean()) < 0.35 and 0.6 < noise.std() < 1.4
    assert gaussians.mixture_k("gaussian_25") == 25
    for bad in ("gaussian", "gaussian_x", "higgs"):
        with pytest.raises(ValueError):
            gaussians.mixture_k(bad)


def test_seed_zero_is_random(spark):
    a, b = (gaussians.gaussian_points(spark, 2, n=20, dims=2, seed=0).orderBy("point_id").first().x for _ in range(2))
    assert a != b


def metrics(spark):
    rows = [("d", None, "a", f"a_{i}", i, 5, 0.1, 1, 0.05, -1, 10 + i, 2, 9.0, float(i), 7.0, 1.0, 2.0, 0.5, 1.5) for i in range(3)]
    rows.append(("d", None, "b", "b_0", 0, 5, 0.1, 1, 0.05, -1, 4, 1, 9.0, 3.0, 7.0, 1.0, 2.0, 0.5, 1.5))
    return spark.createDataFrame(rows, evaluate.METRICS_SCHEMA)


def test_run_file_is_appended_to(spark, tmp_path):
    path = str(tmp_path / "runs")
    for _ in range(2):
        sinks.write_csv(sinks.run_rows(metrics(spark)), path)
    read = spark.read.option("header", True).csv(path)
    assert read.columns == sinks.RUN_COLUMNS and read.count() == 8
    header = next(csv.reader(open(next((tmp_path / "runs").glob("*.csv")))))
    assert header == sinks.RUN_COLUMNS


def test_summary(spark):
    rows = {r.algorithm: r for r in sinks.summarize(metrics(spark)).collect()}
    assert list(rows["a"].asDict()) == ["dataset", "steps", *sinks.SUMMARY_COLUMNS]
    assert rows["a"].num_centers_avg == 11 and rows["a"].num_centers_stdv == 1 and rows["a"].final_risk_avg == 1
    assert rows["b"].final_risk_stdv is None


def test_sweep(spark):
    names = spark.createDataFrame([("higgs",), ("mnist",), ("gaussian_50",)], "dataset string")
    rows = evaluate.sweep_plan(names).collect()
    by_name = {n: [r for r in rows if r.dataset == n] for n in ("higgs", "mnist", "gaussian_50")}
    assert [len(by_name[n]) for n in by_name] == [16 + 15 + 20, 8 + 8 + 10, 4 + 4 + 5]
    assert {r.k for r in by_name["mnist"]} == {10, 30} and {r.k for r in by_name["gaussian_50"]} == {50}
    assert not any((r.algorithm, r.k, r.epsilon) == ("sampled_kmeans", 200, 0.2) for r in rows)
    assert any((r.algorithm, r.k, r.epsilon) == ("sample_prune", 200, 0.2) for r in rows)


def test_run_sweep(spark, make_points, lattice_matrix, monkeypatch):
    for name, values in (("SWEEP_K", [3]), ("SWEEP_EPSILON", [0.2]), ("SWEEP_STEPS", [1, 2])):
        monkeypatch.setattr(evaluate, name, values)
    names = spark.createDataFrame([("a",), ("b",)], "dataset string")
    loaded = []

    def load(name):
        loaded.append(name)
        return make_points(lattice_matrix[: 300 if name == "a" else 200])

    found = evaluate.run_sweep(spark, load, names, rounds=2)
    assert sorted(loaded) == ["a", "b"] and found.count() == 2 * 2 * 4
    summary = sinks.summarize(found).collect()
    assert sorted((r.dataset, r.algorithm, r.steps or 0) for r in summary) == sorted(
        (d, a, s) for d in "ab" for a, s in [("kmeans_parallel", 1), ("kmeans_parallel", 2), ("sample_prune", 0), ("sampled_kmeans", 0)]
    )
    # one first centre and six more in each step
    assert {r.num_centers_avg for r in summary if r.algorithm == "kmeans_parallel" and r.steps == 2} == {13.0}


def test_repeated_runs(spark, make_points, lattice_matrix):
    found = evaluate.compare_runs(
        make_points(lattice_matrix), ["sampled_kmeans", "kmeans_parallel", "sample_prune"], 3, 0.2, rounds=2
    )
    rows = found.collect()
    assert len(rows) == 6 and all(r.risk <= r.risk_final and r.total_time > 0 for r in rows)
    with pytest.raises(ValueError):
        evaluate.run_algorithm(make_points(lattice_matrix), "other", 3, 0.2)


def test_run_tables_live_in_the_shared_folder(spark):
    folder = shared_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (named or spark.sparkContext.getCheckpointDir()) == shared_folder(spark)
    with RunTables(spark) as tables:
        table = tables.write(spark.range(5), "t")
        assert table.count() == 5 and tables.root.startswith(folder)
        tables.drop("t")
        assert not Path(tables.root, "t").exists() and Path(tables.root).exists()
    assert not Path(tables.root).exists()


def test_a_stopped_sweep_goes_on(spark, make_points, lattice_matrix, monkeypatch, tmp_path):
    for name, values in (("SWEEP_K", [3]), ("SWEEP_EPSILON", [0.2]), ("SWEEP_STEPS", [1, 2])):
        monkeypatch.setattr(evaluate, name, values)
    names = spark.createDataFrame([("a",), ("b",)], "dataset string")
    ran, real = [], evaluate.run_algorithm

    def run(points, algorithm, *given, **options):
        if len(ran) == 3:
            raise RuntimeError("stopped")
        ran.append((algorithm, options.get("steps")))
        return real(points, algorithm, *given, **options)

    monkeypatch.setattr(evaluate, "run_algorithm", run)
    options = dict(rounds=1, results=str(tmp_path / "sweep"))
    with pytest.raises(RuntimeError, match="stopped"):
        evaluate.run_sweep(spark, lambda name: make_points(lattice_matrix[:150]), names, **options)
    monkeypatch.setattr(evaluate, "run_algorithm", lambda *given, **o: ran.append(given[1]) or real(*given, **o))
    rows = evaluate.run_sweep(spark, lambda name: make_points(lattice_matrix[:150]), names, **options).collect()
    assert len(ran) == 8 and len(rows) == 8
    assert len({(r.dataset, r.algorithm, r.ep, r.steps) for r in rows}) == 8
    # all are there: nothing is loaded or run
    again = evaluate.run_sweep(spark, lambda name: 1 / 0, names, **options)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows))


def test_spread_deals_out_by_the_splits(spark):
    assert prep.spread(spark.range(0, 1000, numPartitions=9), per_split=16).rdd.getNumPartitions() == 144
    found = prep.spread(spark.range(100).coalesce(1), per_split=2)
    assert found.rdd.getNumPartitions() == 8 and sorted(r.id for r in found.collect()) == list(range(100))


def test_rounded_is_round_without_decimals(spark):
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.3, -0.0, 0.0, 4503599627370497.5, 9007199254740993.0, 1e300,
              -1e300, float("inf"), float("-inf"), float("nan"), None, 1.005 * 100, 104949.5, 2097152.5, -7.4999999999999991]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(F.round("v").alias("want"), prep.rounded(F.col("v")).alias("got")).collect()
    assert [str(r.got) for r in rows] == [str(r.want) for r in rows]
    plan = df.select(prep.rounded(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan
