"""Gapless numbers in a global order, without a task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starsift.session import stored

#: Bits that ``monotonically_increasing_id`` leaves to the place within a partition.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with its rows' places, from 0, in a column ``out``.

    Rows are ordered by range, each task numbers its own, and a range begins
    where the ranges before it end; only one count per range reaches the driver. Rows
    that are equal in ``order`` stand in any order, so make it unique for repeatable places.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    ordered = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright(out, _PLACE_BITS)
    sizes = sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(r.n for r in sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(r.part, at) for r, at in zip(sizes, starts)], "_part long, _offset long"
    )
    place = F.col("_offset") + F.col(out).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*df.columns, place.alias(out))


def length_batches(
    df: DataFrame, size: int, *, length: str = "n_tokens", key: str = "review_id", out: str = "batch"
) -> DataFrame:
    """``df`` with batches of ``size`` rows of like length, shortest first, ties by the key; the last may be smaller.

    A null length comes first, as the shortest.
    """
    rows = numbered(df, [F.col(length).asc_nulls_first(), F.col(key).asc_nulls_first()], "_place")
    return rows.withColumn(out, F.floor(F.col("_place") / size)).drop("_place")


def padding_share(df: DataFrame, *, length: str = "n_tokens", batch: str = "batch") -> DataFrame:
    """One row ``cells, padding, share``: places of all batches filled up to their longest row, and the filling's part."""
    filled = df.groupBy(batch).agg(
        (F.max(length) * F.count("*")).alias("cells"), F.sum(length).alias("used")
    )
    return filled.agg(F.sum("cells").alias("cells"), F.sum(F.col("cells") - F.col("used")).alias("padding")).withColumn(
        "share", F.col("padding") / F.col("cells")
    )
