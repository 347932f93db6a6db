"""Unions, differences and distinct rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_named(frames: Mapping[str, DataFrame], column: str = "split") -> DataFrame:
    """Rows of all frames with the name of the frame they come from."""
    return union_all([df.withColumn(column, F.lit(name)) for name, df in frames.items()])


def except_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that are not in ``right``; nulls compare equal.

    One aggregate over both sides instead of an anti join: repeats collapse in
    the map tasks, so many copies of one row cost nothing in the shuffle.
    """
    both = left.withColumn("_right", F.lit(False)).unionByName(
        right.select(*left.columns).withColumn("_right", F.lit(True))
    )
    seen = both.groupBy(*left.columns).agg(F.max("_right").alias("_right"))
    return seen.filter(~F.col("_right")).select(*left.columns)


def complement(df: DataFrame, part: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows of ``df`` whose (unique) key is not in ``part``."""
    return df.join(part.select(key), key, "left_anti")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
