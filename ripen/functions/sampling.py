"""Row sampling by a hash of the row key.

Unlike a seeded ``sample`` the kept set depends only on key and seed, never on how the
rows are partitioned, so recomputing a lost partition keeps exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash has 48 bits: shares are kept to about 4e-15.
HASH_RANGE = 2**48


def hash_share(key: Column, seed) -> Column:
    """An integer below HASH_RANGE from the first twelve hex digits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def hash_keep(key: Column, fraction: float, seed) -> Column:
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"A share lies between 0 and 1: {fraction}")
    return hash_share(key, seed) < F.lit(round(fraction * HASH_RANGE))
