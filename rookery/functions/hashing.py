"""Repeatable draws: the same key and salt give the same number in any partitioning and in other SQL engines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_uniform(key: Column | str, salt: str | Column = "0") -> Column:
    """A number in [0, 1) from the first 32 bits of md5(key:salt). A null key gives null."""
    key = F.col(key) if isinstance(key, str) else key
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.md5(F.concat(key.cast("string"), F.lit(":"), salt))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stable_normal(key: Column | str, salt: str = "0") -> Column:
    """A standard normal draw, from two uniform ones of the key. A null key gives null."""
    radius = F.sqrt(-2 * F.log(F.greatest(stable_uniform(key, f"{salt}a"), F.lit(2.0**-33))))
    return radius * F.cos(F.lit(2 * math.pi) * stable_uniform(key, f"{salt}b"))
