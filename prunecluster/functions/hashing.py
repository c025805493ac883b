"""Seeded uniform numbers, one per row.

Rows are drawn by comparing a uniform number with a rate: a narrow filter, the same
rows whatever the partitioning, and the same again after a lost executor.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_ID = "point_id"


def md5_uniform(key: Column, seed: int, salt: str, part: int = 0) -> Column:
    """(h + 0.5) / 2^32 with h the ``part``-th group of 8 hex digits of md5("seed:salt:key").

    Any SQL engine can repeat it. It is never 0, so its logarithm is finite.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")))
    digits = F.substring(digest, 8 * part + 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def xxhash_uniform(key: Column, seed: int, salt: str) -> Column:
    """The same idea at a fraction of the CPU cost, with 53 random bits."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(salt), F.lit(seed)), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(9007199254740992.0)


def uniform(points: DataFrame, seed: int, salt: str, method: str = "xxhash64") -> Column:
    """Uniform number for each row of ``points``.

    With a ``point_id`` column it is a hash of the key. Without one it falls back to Spark's
    seeded generator, which is repeatable for one layout of the input; callers freeze what
    they drew in a written table.
    """
    if POINT_ID not in points.columns:
        return F.rand(zlib.crc32(f"{seed}:{salt}".encode()))
    if method == "md5":
        return md5_uniform(F.col(POINT_ID), seed, salt)
    if method == "xxhash64":
        return xxhash_uniform(F.col(POINT_ID), seed, salt)
    raise ValueError(f"unknown uniform method {method!r}; use 'md5' or 'xxhash64'")
