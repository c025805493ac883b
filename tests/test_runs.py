import numpy as np
import pytest

from brute_force import all_d2
from prunecluster import Centers, kmeans_parallel, sample_prune, sampled_kmeans
from prunecluster.catalog.queries import fixed_box, lattice
from prunecluster.operators import cost, rounds
from prunecluster.operators.nearest import with_nearest
from prunecluster.plans.blackbox import reduce_centers, spark_kmeans
from prunecluster.sources.gaussians import gaussian_points, mixture_centers
from prunecluster.storage import RunTables


@pytest.fixture(scope="module")
def items(spark, small):
    return lattice(spark, small).persist()


@pytest.fixture(scope="module")
def mixture(spark):
    """Five clusters of very different sizes with known centres."""
    return gaussian_points(spark, 5, n=20_000, seed=11).drop("cluster").persist()


def fixed(points, seed=7, **options):
    return sampled_kmeans(points, 5, blackbox=fixed_box, reducer=fixed_box, seed=seed, uniform="md5", **options)


def test_one_round_has_the_known_values(spark):
    run = fixed(lattice(spark, "/root/testdata/sf0.01"), max_iter=1, final_risk=False)
    first = run.rounds[0]
    assert first["p2_rows"] == 1221 and first["truncated_risk"] == 24804 and first["survivors"] == 12273
    assert first["handled_risk"] == 1701669 and first["v"] == pytest.approx(72.65389749593578, rel=1e-12)


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_result_does_not_depend_on_partitions(items, partitions):
    run = fixed(items.repartition(partitions))
    assert (run.risk, run.candidate_count, run.iterations) == _whole(items)


_cache = {}


def _whole(items):
    if not _cache:
        run = fixed(items)
        _cache["run"] = (run.risk, run.candidate_count, run.iterations)
    return _cache["run"]


def test_rounds_lose_no_row(items):
    run = fixed(items)
    n, psi = items.count(), 0.0
    assert run.iterations >= 2 and run.rounds[0]["remaining"] == n
    for before, after in zip(run.rounds, run.rounds[1:]):
        assert after["remaining"] == before["survivors"]
    for r in run.rounds:
        assert r["handled"] + r["survivors"] == r["remaining"] and r["psi"] >= psi
        psi = r["psi"]
    assert run.candidates.weights.sum() == n
    assert run.risk <= sum(r["handled_risk"] for r in run.rounds) + run.rounds[-1]["survivors"] * 1e6
    assert run.risk <= run.risk_final
    assert run.total_comps == sum(r["remaining"] * r["center_count"] for r in run.rounds)
    assert 0 < run.comps_per_machine <= run.total_comps


def test_rounds_as_a_table(spark, items):
    run = fixed(items)
    rows = run.rounds_df(spark).orderBy("round").collect()
    assert [r.survivors for r in rows] == [r["survivors"] for r in run.rounds]


def test_no_loop_when_everything_fits(items):
    run = sampled_kmeans(items, 25, seed=3)
    assert run.iterations == 0 and len(run.centers) == 25


def test_fewer_rows_than_centres(make_points):
    run = sampled_kmeans(make_points([[0.0, 1.0], [5.0, 5.0]]), 4)
    assert sorted(run.centers.matrix.tolist()) == [[0.0, 1.0], [5.0, 5.0]] and run.risk_final == 0


def test_equal_points_end_after_one_round(make_points):
    # v is 0 here; all points lie on a centre and are pruned
    run = sampled_kmeans(make_points(np.ones((3000, 2))), 2, seed=2)
    assert run.iterations == 1 and run.rounds[0]["v"] == 0 and run.rounds[0]["survivors"] == 0
    assert run.risk_final == 0 and run.candidates.weights.sum() == 3000


def test_max_iter_leaves_the_rest_to_the_last_step(items):
    run = sampled_kmeans(items, 5, max_iter=0, seed=1)
    assert run.iterations == 0 and run.candidates.weights.sum() == items.count()


def test_a_round_without_progress_ends_the_loop(make_points):
    rng = np.random.default_rng(0)
    far = Centers(np.full((1, 2), 1e9))
    run = sampled_kmeans(
        make_points(rng.normal(size=(3000, 2))), 2, blackbox=lambda p, k, seed: far, reducer=lambda p, k, seed: far,
        max_iter=50, seed=1,
    )
    assert run.iterations < 50


def test_single_cluster_is_near_the_mean(make_points, lattice_matrix):
    mean = lattice_matrix.mean(axis=0)
    assert spark_kmeans()(make_points(lattice_matrix), 1, 1).matrix[0] == pytest.approx(mean)
    run = sampled_kmeans(make_points(lattice_matrix), 1, max_iter=2)
    assert run.risk_final <= 1.02 * all_d2(lattice_matrix, [mean]).sum()


def test_spread_over_m_partitions(items):
    assert fixed(items, m=3).risk == _whole(items)[0]


@pytest.mark.parametrize(
    "wrong", [dict(k=0), dict(k=3, epsilon=0.0), dict(k=3, epsilon=1.0), dict(k=3, delta=0.0), dict(k=3, max_iter=-1), dict(k=3, m=0)]
)
def test_parameters_are_checked(items, wrong):
    with pytest.raises(ValueError):
        sampled_kmeans(items, **wrong)


def test_empty_input_and_unknown_blackbox(items):
    for run in (sampled_kmeans, kmeans_parallel, sample_prune):
        with pytest.raises(ValueError, match="no points"):
            run(items.where("false"), 3)
    with pytest.raises(ValueError, match="black box"):
        sampled_kmeans(items, 3, blackbox="minibatch")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cost_is_near_plain_kmeans(mixture, seed):
    plain = min(cost.risk(mixture, spark_kmeans(20)(mixture, 5, s)) for s in (seed, seed + 10))
    known = cost.risk(mixture, mixture_centers(5, seed=11))
    assert sampled_kmeans(mixture, 5, seed=seed).risk_final <= 1.5 * max(plain, known)


def test_competitors_are_near_plain_kmeans(mixture):
    known = cost.risk(mixture, mixture_centers(5, seed=11))
    assert kmeans_parallel(mixture, 5, seed=4).risk_final <= 1.5 * known
    assert sample_prune(mixture, 5, 0.2, seed=4).risk_final <= 1.5 * known
    assert sampled_kmeans(mixture, 5, seed=4, blackbox="kmeans_parallel").risk_final <= 1.5 * known


def test_kmeans_parallel_draws_exactly_l_rows(items):
    run = kmeans_parallel(items, 4, draws=6, iterations=3, seed=2)
    assert run.candidate_count == 1 + 3 * 6 and run.candidates.weights.sum() == items.count()
    n = items.count()
    assert run.comps_per_machine == n * (1 + 7 + 13)
    assert kmeans_parallel(items, 4, iterations=3, m=7, seed=2).total_comps == 7 * (n // 7 + n * 9 // 7 + n * 17 // 7)


def test_kmeans_parallel_stops_when_all_points_are_centres(make_points):
    run = kmeans_parallel(make_points([[0.0], [1.0], [9.0]]), 2, draws=5, iterations=5)
    assert run.candidate_count == 3 and run.risk == 0.0


def test_sample_prune_with_blocks_equals_one_pass(items):
    reducer = fixed_box
    kept = dict(epsilon=0.2, seed=5, reducer=reducer, uniform="md5")
    whole = sample_prune(items, 3, **kept)
    blocks = sample_prune(items, 3, center_bytes=40_000, keep_centers=True, **kept)
    assert (whole.risk, whole.candidate_count) == (blocks.risk, blocks.candidate_count)
    table = blocks.candidates
    assert table.count() == blocks.candidate_count
    assert table.agg({"weight": "sum"}).first()[0] == items.count()
    assert whole.iterations >= 2


def test_sample_prune_needs_ids(items):
    with pytest.raises(ValueError, match="point_id"):
        sample_prune(items.drop("point_id"), 3)


def test_reduction_leaves_out_centres_without_points(spark):
    candidates = Centers([[0.0], [1.0], [50.0]], weights=np.array([3.0, 1.0, 0.0]))
    assert sorted(reduce_centers(spark, candidates, 2, 1, spark_kmeans()).matrix[:, 0]) == [0.0, 1.0]


def test_prune_is_strict_and_counts_in_the_same_pass(spark, make_points, lattice_matrix):
    points, centers = make_points(lattice_matrix), lattice_matrix[:3]
    d2 = all_d2(lattice_matrix, centers).min(axis=1)
    v = float(np.sort(d2)[200])  # a value that occurs: rows at v itself are pruned
    with RunTables(spark) as tables:
        found = rounds.prune(with_nearest(points, Centers(centers)), v, tables, "s", ["point_id", "x"])
        left = {r.point_id for r in found.survivors.collect()}
    assert left == {f"p{i:05d}" for i in np.flatnonzero(d2 > v)}
    assert found.handled_risk == d2[d2 <= v].sum()
    assert (found.remaining, found.handled) == ((d2 > v).sum(), (d2 <= v).sum())


def test_a_stopped_run_goes_on_behind_its_last_round(spark, items, monkeypatch):
    from prunecluster.plans import sampled_kmeans as module

    whole = fixed(items)
    assert whole.iterations >= 2
    name, real, rounds_done = "stopped-and-resumed", module.prune, []

    def stops(*given, **options):
        if rounds_done:
            raise RuntimeError("the driver is lost")
        rounds_done.append(1)
        return real(*given, **options)

    monkeypatch.setattr(module, "prune", stops)
    with pytest.raises(RuntimeError, match="lost"):
        fixed(items, run_name=name)
    monkeypatch.setattr(module, "prune", lambda *given, **options: rounds_done.append(1) or real(*given, **options))
    with pytest.raises(ValueError, match="was started with"):
        fixed(items, seed=8, run_name=name)
    again = fixed(items, run_name=name)
    assert len(rounds_done) == whole.iterations  # the first round is not done again
    assert np.array_equal(again.centers.matrix, whole.centers.matrix) and again.rounds == whole.rounds
    assert (again.risk, again.total_comps, again.comps_per_machine) == (whole.risk, whole.total_comps, whole.comps_per_machine)
    assert RunTables(spark, name).last_note() is None  # nothing is left of a run that came to its end
    with pytest.raises(ValueError, match="point_id"):
        sampled_kmeans(items.drop("point_id"), 5, run_name="x")


def test_carried_distances_change_nothing_but_the_work(spark, items):
    plain, carried = (
        kmeans_parallel(items, 5, draws=6, iterations=3, seed=3, uniform="md5", reducer=fixed_box, carry=c) for c in (False, True)
    )
    assert np.array_equal(plain.candidates.matrix, carried.candidates.matrix)
    assert np.array_equal(plain.candidates.weights, carried.candidates.weights)
    assert plain.risk == carried.risk and plain.risk_final == carried.risk_final
    n = items.count()
    assert plain.total_comps == n * (1 + 7 + 13) and carried.total_comps == n * (1 + 6 + 6)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("prunecluster_")]


def test_a_carried_step_exchanges_no_points(spark, items):
    from prunecluster.operators.carried import CarriedDistances

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with CarriedDistances(items, buckets=4) as carried:
            carried.add(Centers(np.zeros((1, 4))))
            step = carried.scored(Centers(np.ones((2, 4))))
            plan = step._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert carried.add(Centers(np.ones((2, 4)))).count() == items.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_carried_weights(make_points):
    points = make_points([[0.0], [1.0], [1.0], [10.0]], [2, 1, 0, 4])
    run = kmeans_parallel(points, 2, draws=4, iterations=2, seed=1, carry=True)
    again = kmeans_parallel(points, 2, draws=4, iterations=2, seed=1)
    assert np.array_equal(run.candidates.weights, again.candidates.weights) and run.risk == again.risk
    with pytest.raises(ValueError, match="point_id"):
        kmeans_parallel(points.drop("point_id"), 2, carry=True)


def test_runs_that_share_scans_equal_runs_by_themselves(items, monkeypatch):
    from prunecluster.plans import evaluate, sampled_kmeans as module

    options = dict(rounds=3, seed=7, blackbox=fixed_box, reducer=fixed_box, uniform="md5", max_iter=2)
    alone = evaluate.repeat_runs(items, "sampled_kmeans", 5, 0.05, **options).collect()
    scans = []
    for name in ("center_weights", "risk", "weights_of_sets", "costs"):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *given, real=real, name=name, **o: scans.append(name) or real(*given, **o))
    shared = evaluate.repeat_shared(items, 5, 0.05, **options).collect()
    assert scans == ["weights_of_sets", "costs"]

    def known(rows):
        return [tuple(v for n, v in r.asDict().items() if "time" not in n) for r in rows]

    assert known(shared) == known(alone)


def test_prune_watches_no_more_for_more_machines(spark, make_points, lattice_matrix, monkeypatch):
    points, centers = make_points(lattice_matrix), lattice_matrix[:3]
    d2, watched = all_d2(lattice_matrix, centers).min(axis=1), []
    write = RunTables.write
    monkeypatch.setattr(RunTables, "write", lambda self, df, name: watched.append(df) or write(self, df, name))
    v = float(np.sort(d2)[100])
    with RunTables(spark) as tables:
        found = rounds.prune(with_nearest(points, Centers(centers)), v, tables, "s", ["point_id", "x"], machines=50)
        assert found.survivors.columns == ["point_id", "x"]
        assert found.largest == max(cost.machine_rows(found.survivors, 50))
        none = rounds.prune(with_nearest(points, Centers(centers)), 1e9, tables, "t", ["point_id", "x"], machines=50)
        assert (none.remaining, none.largest) == (0, 0)
    assert "machine 49" not in watched[0]._jdf.queryExecution().analyzed().toString()


def test_the_first_carried_step_writes_one_table(spark, items):
    from prunecluster.operators.carried import SORTED_BUCKETS, CarriedDistances

    before = spark.conf.get(SORTED_BUCKETS)
    with CarriedDistances(items, buckets=4) as carried:
        carried.add(Centers(np.zeros((1, 4))))
        assert len(carried.tables) == 1 and carried.known.count() == items.count()
        carried.add(Centers(np.ones((2, 4))))
        carried.add(Centers(np.full((1, 4), 5.0)))
        assert len(carried.tables) == 2 and carried.known.count() == items.count()
    assert spark.conf.get(SORTED_BUCKETS) == before
