"""Closed formulas that size samples, centre sets and thresholds.

Every formula is written once over a small set of mathematical primitives, so the
driver loop (plain numbers) and the reporting queries (columns) share one source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, Callable

from pyspark.sql import functions as F

# Constants of the published algorithm and its usual settings.
PHI_ALPHA_C = 6.5
MAX_SS_SIZE_C = 36
KPLUS_C = 9
KPLUS_SCALER = 1
LOG_FACTOR = 1.1
DELTA = 0.1
L_TO_K_RATIO = 2.0
INNER_L_TO_K_RATIO = 2.0
INNER_ITERATIONS = 5
SAMPLE_C = 9
PIVOT_C = 4
TAIL_C = 8
MACHINES = 50


@dataclass(frozen=True)
class Primitives:
    """ln, power and truncation for one kind of operand (all operands are positive)."""

    ln: Callable[[Any], Any]
    power: Callable[[Any, Any], Any]
    truncate: Callable[[Any], Any]


NUMBERS = Primitives(ln=math.log, power=math.pow, truncate=math.floor)
COLUMNS = Primitives(
    ln=lambda c: F.ln(c), power=lambda b, e: F.pow(b, e), truncate=lambda c: F.floor(c).cast("bigint")
)


def oversampled_k(k, delta, epsilon, on: Primitives = NUMBERS):
    """Number of centres asked for in each round (a little more than k)."""
    spread = on.ln(LOG_FACTOR * k / (delta * epsilon))
    return KPLUS_SCALER * on.truncate(k + KPLUS_C * spread)


def max_subset(n, k, epsilon, delta, on: Primitives = NUMBERS):
    """Row count up to which the survivors are clustered directly."""
    return on.truncate(MAX_SS_SIZE_C * k * on.power(n, epsilon) * on.ln(LOG_FACTOR * k / delta))


def sampling_rate(subset, remaining):
    """Fraction alpha of the survivors drawn into each of the two samples."""
    return subset / remaining


def phi_alpha(alpha, k, delta, epsilon, on: Primitives = NUMBERS):
    return (PHI_ALPHA_C / alpha) * on.ln(LOG_FACTOR * k / (delta * epsilon))


def outlier_rows(alpha, k, phi, on: Primitives = NUMBERS):
    """Number of farthest sample rows left out of the truncated cost."""
    return on.truncate(1.5 * alpha * (k + 1) * phi)


def scaled_cost(truncated, alpha):
    """Truncated sample cost scaled up to the whole survivor set."""
    return (2.0 / (3.0 * alpha)) * truncated


def reach(psi, k, phi):
    """Squared distance v up to which a point counts as well served."""
    return psi / (k * phi)


def sample_rate_s(k, n, epsilon, remaining, on: Primitives = NUMBERS):
    """Sample-and-prune: fraction of survivors that join the centre set."""
    return SAMPLE_C * k * on.power(n, epsilon) * on.ln(n) / remaining


def sample_rate_h(n, epsilon, remaining, on: Primitives = NUMBERS):
    """Sample-and-prune: fraction of survivors used to pick the pivot distance."""
    return PIVOT_C * on.power(n, epsilon) * on.ln(n) / remaining


def sample_prune_subset(k, n, epsilon, on: Primitives = NUMBERS):
    """Sample-and-prune: row count at which the loop stops."""
    return (PIVOT_C / epsilon) * k * on.power(n, epsilon) * on.ln(n)


def tail_rank(n, on: Primitives = NUMBERS):
    """Rank, from the far end, of the pivot distance."""
    return on.truncate(TAIL_C * on.ln(n))


def draws_per_step(k, ratio=L_TO_K_RATIO, on: Primitives = NUMBERS):
    """Rows drawn in each k-means|| step."""
    return on.truncate(ratio * k)
