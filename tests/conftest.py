import os
import sys

import numpy as np
import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from prunecluster.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="4g")


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def make_points(spark):
    """Point table from a matrix, with string ids p0000, p0001, ..."""

    def make(matrix, weights=None, partitions=3):
        rows = [(f"p{i:05d}", [float(v) for v in x]) for i, x in enumerate(matrix)]
        schema = "point_id string, x array<double>"
        if weights is not None:
            rows = [(*r, float(w)) for r, w in zip(rows, weights)]
            schema += ", w double"
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


@pytest.fixture
def lattice_matrix():
    rng = np.random.default_rng(3)
    return rng.integers(0, 30, size=(400, 3)).astype(float)
