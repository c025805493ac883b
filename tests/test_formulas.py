import math

import pytest
from pyspark.sql import functions as F

from prunecluster.functions import formulas as f


def test_published_sizes():
    # lineitem at scale 0.01 with k=5, epsilon=0.05, delta=0.1
    n, k, e, d = 60_000, 5, 0.05, 0.1
    subset = f.max_subset(n, k, e, d)
    alpha = f.sampling_rate(subset, n)
    assert (subset, f.oversampled_k(k, d, e)) == (1250, 68)
    assert f.outlier_rows(alpha, k, f.phi_alpha(alpha, k, d, e)) == 409


@pytest.mark.parametrize("k,expected", [(3, 253), (10, 825), (25, 2183)])
def test_outlier_rows_do_not_depend_on_alpha(k, expected):
    for alpha in (0.01, 0.3, 1.0):
        assert f.outlier_rows(alpha, k, f.phi_alpha(alpha, k, 0.1, 0.05)) == expected


def test_reach_and_scaled_cost():
    assert f.scaled_cost(30.0, 0.1) == pytest.approx(200.0)
    assert f.reach(200.0, 4, 5.0) == 10.0


def test_sample_prune_formulas():
    n, k, e = 1000, 3, 0.2
    assert f.sample_rate_s(k, n, e, 500) == pytest.approx(9 * 3 * 1000**0.2 * math.log(1000) / 500)
    assert f.sample_rate_h(n, e, 500) == pytest.approx(4 * 1000**0.2 * math.log(1000) / 500)
    assert f.sample_prune_subset(k, n, e) == pytest.approx(20 * 3 * 1000**0.2 * math.log(1000))
    assert f.tail_rank(n) == int(8 * math.log(1000))


def test_columns_agree_with_numbers(spark):
    rows = [(n, k, e, d) for n in (50, 60_000, 10**12) for k in (1, 5, 200) for e in (0.01, 0.2) for d in (0.1, 0.5)]
    df = spark.createDataFrame(rows, "n bigint, k int, e double, d double")
    n, k, e, d = (F.col(c) for c in "nked")
    alpha = F.lit(0.25)
    found = df.select(
        "*",
        f.oversampled_k(k, d, e, f.COLUMNS).alias("kplus"),
        f.max_subset(n, k, e, d, f.COLUMNS).alias("subset"),
        f.outlier_rows(alpha, k, f.phi_alpha(alpha, k, d, e, f.COLUMNS), f.COLUMNS).alias("r"),
        f.tail_rank(n, f.COLUMNS).alias("rank"),
        f.draws_per_step(k, on=f.COLUMNS).alias("l"),
    ).collect()
    for row in found:
        assert row.kplus == f.oversampled_k(row.k, row.d, row.e)
        assert row.subset == f.max_subset(row.n, row.k, row.e, row.d)
        assert row.r == f.outlier_rows(0.25, row.k, f.phi_alpha(0.25, row.k, row.d, row.e))
        assert row["rank"] == f.tail_rank(row.n)
        assert row.l == f.draws_per_step(row.k)
