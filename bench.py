"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads (default 8).
The session is warmed up by one small run and one assignment; each query then runs once, to the end.
"""

from __future__ import annotations

import json
import os
import time

from prunecluster.catalog import queries as q
from prunecluster.plans.blackbox import spark_kmeans
from prunecluster.operators.cost import risk
from prunecluster.plans.kmeans_parallel import kmeans_parallel
from prunecluster.plans.sample_prune import sample_prune
from prunecluster.plans.sampled_kmeans import sampled_kmeans
from prunecluster.session import local_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    # The test files hold one row group each, so points are spread over the threads once, as a
    # table on a cluster would be.
    points = q.lattice(spark, folder).repartition(cpus).persist()
    rows = points.count()
    sampled_kmeans(points, 2, 0.1, max_iter=1)
    q.risk(spark, folder).collect()

    seconds, risks = {}, {}

    def timed(name, run):
        start = time.perf_counter()
        result = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    for k in (5, 25):
        risks[f"sampled_kmeans_k{k}"] = timed(f"sampled_kmeans_k{k}", lambda: sampled_kmeans(points, k)).risk_final
        risks[f"plain_kmeans_k{k}"] = timed(
            f"plain_kmeans_k{k}", lambda: risk(points, spark_kmeans(max_iter=20)(points, k, 1))
        )
        risks[f"kmeans_parallel_k{k}"] = timed(f"kmeans_parallel_k{k}", lambda: kmeans_parallel(points, k)).risk_final
    risks["sample_prune_k5"] = timed("sample_prune_k5", lambda: sample_prune(points, 5, 0.1)).risk_final
    for name in (
        "risk", "assign_nearest", "center_weights", "truncated_risk", "paired_sample", "weighted_sample",
        "survivors", "one_round", "nearest_cosine", "one_hot", "min_max_scale", "gaussian_points", "plan_parameters",
    ):
        timed(name, lambda: q.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())

    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "rows": rows,
        "risk_final": {name: round(value, 1) for name, value in risks.items()},
    }))


if __name__ == "__main__":
    main()
