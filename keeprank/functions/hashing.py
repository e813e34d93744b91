"""Stable hashes. ``md5_60`` gives the same integer in any engine; ``xxhash64`` is the cheap choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def md5_60(*parts) -> Column:
    """First 60 bits of the md5 of the parts joined with ':'."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_bucket(value: Column, buckets: int, method: str = "xxhash64", salt: str = "") -> Column:
    if method == "xxhash64":
        return F.pmod(F.xxhash64(value, F.lit(salt)), F.lit(buckets))
    if method == "md5":
        return md5_60(value, salt) % F.lit(buckets)
    raise ValueError(f"unknown method {method!r}")
