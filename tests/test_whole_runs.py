"""Queries that run a plan to its end, on line items of their own, whose number and spread call for more than one round."""

import numpy as np
import pandas as pd
import pytest

import check_queries
from prunecluster.catalog import oracles, queries
from prunecluster.plans import evaluate
from prunecluster.plans.sample_prune import sample_prune
from prunecluster.plans.sampled_kmeans import sampled_kmeans


@pytest.fixture
def line_items(tmp_path):
    """Makes a folder with n line items, a share ``far`` of them anywhere and the others close together."""

    def make(n, far=1.0):
        rng = np.random.default_rng(n)
        price = np.where(rng.random(n) < far, rng.integers(0, 10**7, n), rng.integers(0, 20_000, n))
        pd.DataFrame({
            "l_orderkey": np.arange(n), "l_linenumber": np.ones(n, np.int32), "l_partkey": rng.integers(0, 9, n),
            "l_suppkey": rng.integers(0, 9, n), "l_extendedprice": price.astype(float),
            "l_quantity": rng.integers(1, 51, n).astype(float), "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100,
        }).to_parquet(tmp_path / "lineitem.parquet")
        return str(tmp_path)

    return make


# no round at all, one and not two came before the stop size; more than the stop size is left after two
@pytest.mark.parametrize("n", [60, 150, 900, 40_000])
def test_two_rounds_at_any_size(spark, line_items, n):
    folder = line_items(n)
    found = queries.ene_two_rounds(spark, folder).toPandas()
    assert check_queries.difference(found, check_queries.tables(folder).execute(oracles.ORACLES["ene_two_rounds"]).df()) is None
    assert sorted(found["round"]) == [1, 2]
    last = found[found["round"] == 2].iloc[0]
    assert last.centers_in_all == last.sample_rows + last.survivors
    if n == 40_000:
        assert last.survivors > 20 * n**0.2 * np.log(n)


def test_all_survivors_of_bounded_rounds_join_the_sample(make_points):
    points = make_points(np.random.default_rng(5).normal(size=(2000, 2)))
    kept = dict(reducer=queries.fixed_box, final_risk=False)
    none = sample_prune(points, 2, 0.5, max_iter=0, **kept)
    assert (none.rounds, none.candidate_count, none.risk) == ([], 2000, 0.0)
    one = sample_prune(points, 1, 0.9, min_iter=1, **kept)
    assert len(one.rounds) == 1 and not one.capped
    with pytest.raises(ValueError, match="min_iter"):
        sample_prune(points, 2, max_iter=1, min_iter=2)


def twin(folder, *runs):
    return check_queries.tables(folder).execute("\nUNION ALL\n".join(f"SELECT * FROM ({r})" for r in runs)).df()


def test_a_sweep_runs_to_the_end(spark, line_items, monkeypatch):
    folder, ran, real = line_items(12_000, far=0.2), [], evaluate.run_algorithm
    monkeypatch.setattr(evaluate, "run_algorithm", lambda *given, **o: ran.append(real(*given, **o)) or ran[-1])
    metrics = queries._sweep(spark, folder, lambda grid: grid.where("dataset = 'lineitem' AND epsilon = 0.1"))
    found = queries._summary(metrics).select(*queries.SWEPT).na.fill(0, ["steps"]).toPandas()
    assert sorted(r.algorithm for r in ran) == ["sample_prune", "sampled_kmeans"]
    assert all(len(r.rounds) > 1 and not r.capped and r.rounds[-1]["survivors"] <= r.capacity for r in ran)
    ways = (oracles.sampled_sql, oracles.pruned_sql)
    assert check_queries.difference(found, twin(folder, *[w(oracles.POINTS, "lineitem", "0.1") for w in ways])) is None


def test_rounds_without_a_bound(spark, line_items):
    folder = line_items(6000)
    run = sampled_kmeans(
        queries.lattice(spark, folder), 5, 0.01, 0.1, blackbox=queries.fixed_box, reducer=queries.fixed_box, seed=queries.SEED,
        uniform="md5", max_iter=None,
    )
    assert len(run.rounds) > 2 and not run.capped
    row = twin(folder, oracles.sampled_sql(oracles.POINTS, "lineitem", "0.01")).iloc[0]
    assert (row.num_centers_avg, row.final_risk_avg, row.comps_tot_avg) == (run.candidate_count, run.risk_final, run.total_comps)
