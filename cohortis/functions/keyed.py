"""Keyed randomness: draws are hashes of ``seed:purpose:key``.

A row gets the same draw whatever the partitioning, the retry count or the
cluster size, and any SQL engine with md5 can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyed_hash(seed: int, purpose: str, *keys: Column | str) -> Column:
    """Non-negative 60-bit integer from md5 of the colon-joined key."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[_col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def keyed_uniform(seed: int, purpose: str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return keyed_hash(seed, purpose, *keys).cast("double") / F.lit(float(2**HASH_BITS))


def keyed_index(n: Column, seed: int, purpose: str, *keys: Column | str) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(keyed_hash(seed, purpose, *keys), n)
