"""Joining one-row-per-key tables to rows whose keys may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starsift.session import stored

#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are
#: never more than HOT_SHARE hot keys and a table of them is safe to broadcast.
HOT_SHARE = 10_000
#: Keys of a narrow table (a few numbers a row) that are sent to the tasks: the commonest, at most so many.
HOT_KEYS = 1 << 18
#: Components of vectors that are sent to the tasks as a whole; a larger table is joined.
MAX_BROADCAST_VALUES = 48_000_000


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than 1/``share`` of the rows counted in ``counts.n``."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.filter(F.col(n) * F.lit(share) > total).select(*keys)


def common_keys(counts: DataFrame, keys: Sequence[str], n: str, most: int) -> tuple[DataFrame, bool]:
    """The commonest keys of ``counts``, at most ``most``, and whether these are all.

    Keys are counted by the leading bits of ``n``, so a few rows come to the driver; keys of
    like count stay together, so somewhat fewer than ``most`` may be given.
    """
    size = F.col(n).cast("double")
    unit = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1.0)))) - 6)
    low = F.when(size < 1, F.lit(0.0)).otherwise(F.floor(size / unit) * unit)
    bins = counts.groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("keys")).collect()
    bins = sorted(((r.low or 0.0, r["keys"]) for r in bins), reverse=True)
    if sum(size for _, size in bins) <= most:
        return counts.select(*keys), True
    floor, held = float("inf"), 0
    for least, size in bins:
        held += size
        if held > most:
            break
        floor = least
    return counts.filter(F.col(n) >= floor).select(*keys), False


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    *,
    counts: DataFrame,
    n: str = "n",
    share: int = HOT_SHARE,
    most: int | None = None,
) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per key).

    ``counts`` says how many rows each key has; it is read several times, so pass
    a stored table if it is costly to compute. Rows of hot keys meet their few
    table rows by broadcast and are never shuffled; all other rows take part in
    an ordinary shuffled join, where no key can fill a task. The two parts are
    disjoint and together give every joined row.

    With ``most``, for narrow tables, the hot keys are the commonest instead, at most so many. If
    these are all keys of ``counts``, which must then hold every key of the rows that the table
    has, no row is shuffled and ``rows`` is read once.
    """
    keys = list(keys)
    every = False
    if most is None:
        hot = hot_keys(counts, keys, n, share)
    else:
        hot, every = common_keys(counts, keys, n, most)
    hot_part = rows.join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys)
    if every:
        return hot_part
    cold_part = rows.join(F.broadcast(hot), keys, "left_anti").join(
        table.join(F.broadcast(hot), keys, "left_anti"), keys
    )
    return hot_part.unionByName(cold_part)


def drop_hot(
    rows: DataFrame, counts: DataFrame, keys: Sequence[str], *, n: str, floor: int,
    share: int = HOT_SHARE,
) -> DataFrame:
    """``rows`` without those of hot keys that also count at least ``floor``."""
    total = counts.agg(F.sum(n)).scalar()
    hot = counts.filter((F.col(n) * F.lit(share) > total) & (F.col(n) >= F.lit(floor)))
    return rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")


def with_group_stats(
    df: DataFrame, keys: Sequence[str], *, share: int = HOT_SHARE, **stats: Column
) -> DataFrame:
    """Each row with aggregates of its group.

    A window over the group would sort a hot group in one task; here the
    aggregates are combined before the shuffle and looked up.
    """
    keys = list(keys)
    rows = df.dropna(subset=keys)
    groups = stored(
        rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), *[c.alias(name) for name, c in stats.items()]
        ),
        "groups",
    )
    return lookup(rows, groups.drop("_n"), keys, counts=groups, n="_n", share=share)
