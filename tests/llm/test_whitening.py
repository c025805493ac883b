import numpy as np
import pytest

from prunecluster.llm import whitening
from prunecluster.llm.queries import op11_whitening
from prunecluster.llm.whitening import fit_whitening, leading_vectors, whiten

COLUMNS = "vec_id long, embedding array<float>, label int, x string, component int"


@pytest.fixture
def make_vectors(spark):
    def make(rows, partitions=3):
        full = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 9) for i, v in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(partitions)

    return make


def brute(rows, count=8):
    """vec_id, deviation, whitened row of each usable vector, and the explained parts, by a covariance as a whole."""
    kept = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(1024 * v).astype(np.int64) + 100_000 for _, v in kept])
    n, total = len(x), x.sum(axis=0)
    exact = n * x - total
    c = exact / n
    v = c.T @ c / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return [i for i, _ in kept], (exact**2).sum(axis=1), c @ vectors / np.sqrt(values), values / np.trace(v)


def check(df, rows, count=8):
    ids, deviation, white, explained = brute(rows, count)
    count = white.shape[1]
    found = df.toPandas()
    assert list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(found) == len(ids) * count
    assert (found.n == len(ids)).all() and found.identity_error.nunique() <= 1 and (found.identity_error <= 1e-12).all()
    for part, own in found.groupby("component"):
        sign_free = [np.sort(own.whitened.to_numpy()), np.sort(-own.whitened.to_numpy())]
        expected = np.sort(white[:, part - 1])
        assert min(np.abs(s - expected).max() for s in sign_free) < 1e-8
        assert np.allclose(own.explained, explained[part - 1], rtol=1e-12)
        assert sorted(own.deviation) == sorted(deviation)
        assert sorted(own.vec_id.dropna()) == sorted(i for i in ids if i is not None)


def test_equals_the_whole_covariance(make_vectors):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 20)) * np.linspace(0.1, 1, 20))]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]  # without id, and repeated
    bad = [(900, None), (901, [np.nan] * 20), (902, [1.0] * 19 + [None]), (903, [np.inf] + [0] * 19)]
    for partitions in (1, 7):
        check(whiten(make_vectors(rows + bad, partitions)), rows)


def test_few_dimensions_and_the_query(spark, small, make_vectors):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(50, 3)))]
    check(whiten(make_vectors(rows)), rows)
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check(op11_whitening(spark, small), given)


def test_odd_tables(make_vectors):
    assert whiten(make_vectors([])).count() == 0
    assert whiten(make_vectors([(1, [1.0, 2.0])])).count() == 0
    assert whiten(make_vectors([(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whiten(make_vectors([(1, None), (2, [None]), (3, [])])).count() == 0
    # one direction alone: one component
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    check(whiten(make_vectors(line)), line, 1)
    # of other lengths, the one that most vectors have
    mixed = line + [(20, [1.0]), (21, []), (22, [1.0, 2.0, 3.0, 4.0])]
    check(whiten(make_vectors(mixed)), line, 1)


def test_large_numbers_stay_exact():
    x = np.array([[1 << 61, -(1 << 61)], [5, 7]], dtype=np.int64)
    sums = [(1 << 61) + 5, 7 - (1 << 61)]
    exact, _ = whitening.centred(x, 2, sums)
    assert exact.tolist() == [[2 * a - s for a, s in zip(row, sums)] for row in x.tolist()]
    assert whitening.deviations(exact) == [None, None]
    assert whitening.deviations(np.array([[1 << 30, 3]])) == [(1 << 60) + 9]


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 150), np.r_[5, 5, 5, 4, 4, np.ones(50)], np.geomspace(1, 1e-12, 40), np.ones(30), np.r_[1.0, np.zeros(20)],
    np.r_[1e6, 1 + np.arange(200) * 1e-3],
])
def test_eigenvectors(values):
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(len(values), len(values))))[0]
    v = (turn * values) @ turn.T
    v = (v + v.T) / 2
    found, vectors, residuals = leading_vectors(lambda q: v @ q, len(v), 8)
    expected = np.sort(np.linalg.eigvalsh(v))[::-1][:8]
    assert np.abs(found - expected).max() < 1e-13 * expected[0]
    assert residuals.max() < 1e-13 * expected[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13


def test_products_are_few(make_vectors):
    rng = np.random.default_rng(5)
    fit = fit_whitening(make_vectors([(i, v) for i, v in enumerate(rng.normal(size=(400, 64)))]))
    assert fit.products <= 40 and fit.residuals.max() <= 1e-13 * fit.values[0] and fit.identity_error < 1e-12
