"""Repeatable hashes of a row key.

Random splits and unordered limits change with the partitioning of the input.
Everything here depends on the key and the seed only, so a retried task or a
different cluster size gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(key: Column | str, seed: int | None = None) -> Column:
    """First 32 bits of md5(key) or md5(key|seed), as a non-negative bigint."""
    text = _col(key).cast("string")
    if seed is not None:
        text = F.concat_ws("|", text, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bucket(key: Column | str, n: int, seed: int | None = None) -> Column:
    """Bucket 0..n-1 of a key."""
    return F.pmod(hash32(key, seed), F.lit(n)).cast("int")
