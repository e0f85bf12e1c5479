"""Reproducible pseudo-random keys.

Random choices must survive task retries and repartitioning, so they are
functions of the row's key.  md5 gives the same number on every engine, which
lets sampling operators be checked with plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 60


def stable_hash(seed: int, *cols: str | Column) -> Column:
    """60-bit non-negative hash of ``seed|col|col...``."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_below(seed: int, percent: int, *cols: str | Column) -> Column:
    """True for about ``percent`` % of keys."""
    return F.pmod(stable_hash(seed, *cols), F.lit(100)) < percent
