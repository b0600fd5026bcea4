"""Reproducible pseudo-random numbers from identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def hash_bucket(salt: str, key: Column) -> Column:
    """An integer in ``[0, 2**32)`` that depends on ``salt`` and ``key`` only.

    It does not depend on partitioning, so a task that runs twice gives the same value.
    """
    digest = F.md5(F.concat_ws("|", F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
