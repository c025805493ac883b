"""What a run returns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.centers import Centers


@dataclass
class ClusteringResult:
    algorithm: str
    k: int
    centers: Centers
    candidates: Centers | DataFrame | None
    candidate_count: int
    iterations: int
    risk: float
    risk_final: float | None
    total_comps: float = 0.0
    comps_per_machine: float = 0.0
    capacity: float = -1.0
    scan_seconds: float = 0.0
    total_seconds: float = 0.0
    rounds: list[dict] = field(default_factory=list)
    #: Rounds ended before few enough rows were left; a black box clustered the rest, or (sample_prune) all of it was kept.
    capped: bool = False

    def rounds_df(self, spark: SparkSession) -> DataFrame:
        """One row per round with its counts, threshold and costs."""
        schema = (
            "round int, remaining bigint, alpha double, p1_rows bigint, p2_rows bigint, center_count int, r bigint, "
            "truncated_risk double, psi double, v double, handled bigint, handled_risk double, survivors bigint"
        )
        names = [f.split()[0] for f in schema.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.rounds], schema)


class Stopwatch:
    """Elapsed seconds of named parts of a run."""

    def __init__(self):
        import time

        self._now = time.perf_counter
        self._start = self._now()
        self.scan = 0.0

    def total(self) -> float:
        return self._now() - self._start

    def scanning(self):
        watch = self

        class Part:
            def __enter__(self):
                self.start = watch._now()

            def __exit__(self, *_):
                watch.scan += watch._now() - self.start

        return Part()
