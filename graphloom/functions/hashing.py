"""Orders that look random and never change: every draw, shuffle and tie is decided by a hash of its key.

A run with the same seed gives the same rows on any cluster, whatever the partitions are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that order_hash has: 15 hex digits.
HASHES = 1 << 60


def order_hash(seed: int | str, *columns: Column | str) -> Column:
    """A long from 0 to HASHES - 1 for the columns' values."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def draw(below: Column | int, seed: int | str, *columns: Column | str) -> Column:
    """A number from 0 to below - 1."""
    return F.pmod(order_hash(seed, *columns), F.lit(below) if isinstance(below, int) else below)
