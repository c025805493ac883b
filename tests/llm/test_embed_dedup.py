import math

import numpy as np
import pytest

from prunecluster.llm import embed_dedup as m


def slow(rows, threshold):
    """(n_links, component) by id, over all pairs in double precision."""
    good = {}
    for i, x in rows:
        if x is not None and i is not None and len(x) and all(c is not None and math.isfinite(c) for c in x) and any(x):
            v = np.array(x, np.float32).astype(float)
            good[i] = v / np.linalg.norm(v)
    links = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold] for i in good}
    label = {i: i for i, _ in rows if i is not None}
    for _ in label:
        for i, others in links.items():
            for j in others:
                label[i] = label[j] = min(label[i], label[j])
    return {i: (len(links.get(i, [])), label[i]) for i in label}


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, x, 1, 2) for i, x in rows], f"vec_id long, embedding array<{kind}>, node int, weight int").repartition(3)


def sets(seed, d=16, n=260):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=d) for _ in range(n)]
    centre = rng.normal(size=d)
    rows += [centre + rng.normal(size=d) * 0.08 for _ in range(90)]
    rows += [rows[5]] * 7 + [rows[300] * 3.0]
    rows += [x + rng.normal(size=d) * 0.12 for x in rows[:80]]
    return [(int(i), [float(np.float32(c)) for c in x]) for i, x in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("seed,block_size", [(0, 2048), (1, 16)])
def test_against_all_pairs(spark, seed, block_size):
    rows = sets(seed)
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] + [0.0] * 15), (906, [1.0] * 3), (907, [2.0] * 3), (908, [1.0]), (909, [-1.0])]
    found = m.embedding_dedup(frame(spark, rows + odd), block_size=block_size).collect()
    want = slow(rows + odd, 0.95)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found}
    links = sum(n for n, _ in want.values())
    assert sum(got[i][0] for i in got) >= 0.995 * links
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(got[i] == want[i] for i, _ in odd)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found) and len(found) == len(want)


def test_recall_at_the_threshold():
    plan = m.calibrate(64, 100_000, 0.95, 0.999, 5)
    rng = np.random.default_rng(99)
    x, z = rng.normal(size=(2, 3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1)[:, None]
    (a, at), (b, bt) = plan.place(x), plan.place(y)
    n = len(x)
    counts, first = m._collisions(np.r_[a, b], np.r_[at, bt], np.arange(n), np.arange(n) + n, plan.window)
    passing = counts >= plan.least
    assert passing.mean() >= 0.995 and plan.least >= 2
    # The first shared list is among those that both vectors are posted in.
    posted = a.shape[1] - plan.least + 1
    assert all(f in set(r[:posted]) for f, r, ok in zip(first, a, passing) if ok)


def test_places_are_the_largest_projections():
    plan = m.Projections(5, 2, 6, 1.0, 1, 1.0, 3)
    x = np.random.default_rng(0).normal(size=(4, 5))
    r, s = plan.rotations()
    numbers, values = plan.place(x)
    for row, n, v in zip(x, numbers, values):
        p, q = (np.r_[row @ t, -(row @ t)] for t in (r, s))
        sums = (p[:, None] + q[None]).ravel() / math.sqrt(2)
        assert set(n) == set(np.argsort(-sums)[:6]) and np.allclose(v, sums[n])


def test_doubles_repeats_and_empty_table(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    found = m.embedding_dedup(frame(spark, rows, "double")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found) == [
        (0, 0, 0, False), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True),
    ]
    assert m.embedding_dedup(frame(spark, rows).limit(0)).count() == 0
