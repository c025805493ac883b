"""The steps of one round: estimate a reach, prune what lies within it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import formulas
from ..functions.centers import Centers
from ..storage import RunTables
from .cost import machine_of, truncated_risk, weight_of
from .nearest import with_nearest


# The column of the written survivors that holds their machine.
MACHINE = "machine_of_row"


@dataclass(frozen=True)
class Estimate:
    """Outcome of the estimation step."""

    centers: Centers
    alpha: float
    phi: float
    r: int
    truncated_risk: float
    psi: float
    v: float


def estimate(
    p2: DataFrame,
    centers: Centers,
    alpha: float,
    k: int,
    delta: float,
    epsilon: float,
    previous_psi: float = 0.0,
    measure: str = "euclidean",
) -> Estimate:
    """How far points served by ``centers`` reach, judged on the second sample.

    psi never decreases from round to round.
    """
    phi = formulas.phi_alpha(alpha, k, delta, epsilon)
    r = formulas.outlier_rows(alpha, k, phi)
    scored = with_nearest(p2, centers, measure).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cost = truncated_risk(scored, r)
    finally:
        scored.unpersist()
    psi = max(formulas.scaled_cost(cost, alpha), previous_psi)
    return Estimate(centers, alpha, phi, r, cost, psi, formulas.reach(psi, k, phi))


@dataclass(frozen=True)
class Pruned:
    survivors: DataFrame
    remaining: int
    handled: int
    handled_risk: float
    #: Survivors of the machine that has most of them.
    largest: int


def beyond(scored: DataFrame, v: float, d2: str = "d2") -> DataFrame:
    """Rows strictly farther than v."""
    return scored.where(F.col(d2) > F.lit(v))


def prune(
    scored: DataFrame, v: float, tables: RunTables, name: str, keep: list[str], machines: int = 1, method: str = "xxhash64"
) -> Pruned:
    """Writes the rows beyond v; counts and the cost of the others are taken in the same pass.

    Each survivor is written with its machine, and those of a machine are counted from that column alone.
    """
    seen = Observation()
    beyond_v = F.col("d2") > F.lit(v)
    watched = scored.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(beyond_v, 1)).alias("remaining"),
        F.sum(F.when(~beyond_v, F.col("d2") * weight_of(scored))).alias("handled_risk"),
    )
    written = tables.write(beyond(watched, v).select(*keep, machine_of(scored, machines, method).alias(MACHINE)), name)
    counts = seen.get
    per_machine = written.groupBy(MACHINE).count().collect()
    return Pruned(
        written.select(*keep), counts["remaining"], counts["rows"] - counts["remaining"], counts["handled_risk"] or 0.0,
        max((r["count"] for r in per_machine), default=0),
    )
