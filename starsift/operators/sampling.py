"""Repeatable limits, class caps, splits and folds, all keyed on a hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starsift.functions.hashing import bucket, hash32
from starsift.operators.lookup import HOT_SHARE, hot_keys
from starsift.session import stored

#: The cut is searched in 2**CUT_BITS slices of the hash range.
CUT_BITS = 16


def _place(df: DataFrame, key: str, seed: int | None) -> dict[str, Column]:
    """Columns that order the rows: ``_h``, then the key, then ``_whole``.

    A row with a key is placed by the key's hash. Rows without one come after all
    others, by a hash of the whole row, so they are spread over slices as well.
    """
    columns = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    whole = F.xxhash64(F.lit(seed or 0), *columns)
    low = whole.bitwiseAND(F.lit(2**32 - 1)) + F.lit(2**32)
    none = F.col(key).isNull()
    return {
        "_h": F.when(none, low).otherwise(hash32(key, seed)),
        "_whole": F.when(none, whole),
    }


def _slices(df: DataFrame, key: str, by: Sequence[str], seed: int | None) -> DataFrame:
    """Row counts per (group, hash slice), with the rows before each slice.

    At most 2 * 2**CUT_BITS rows per group, and combined before the shuffle.
    """
    sliced = df.select(*by, _slice(_place(df, key, seed)["_h"]).alias("_slice"))
    sizes = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*(by or [F.lit(0)])).orderBy("_slice")
    return stored(sizes, "slices").withColumn("_before", F.sum("_n").over(order) - F.col("_n"))


def _slice(h: Column) -> Column:
    return F.shiftright(h, 32 - CUT_BITS)


def _edges(slices: DataFrame, n: Column) -> DataFrame:
    """The slice that holds row ``n`` of its group; none for smaller groups."""
    upto = F.col("_before") + F.col("_n")
    return slices.filter((F.col("_before") < n) & (upto >= n))


def _flag(df: DataFrame, slices: DataFrame, n: Column, key: str, seed: int | None, flag: str):
    edge = _edges(slices, n).select(F.struct("_slice", "_before")).scalar()
    place = _place(df, key, seed)
    own = F.struct(place["_h"].alias("_h"), F.col(key).alias("_key"), place["_whole"].alias("_whole"))
    ranked = df.select(own.alias("_own")).filter(_slice(F.col("_own._h")) == edge["_slice"])
    ranked = ranked.withColumn(
        "_place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_own"))
    )
    cut = ranked.filter(F.col("_place") == n - edge["_before"]).select("_own").scalar()
    return df.withColumn(flag, (n > 0) & F.coalesce(own <= cut, F.lit(True)))


def flag_first(
    df: DataFrame, n: int, *, key: str, seed: int | None = None, flag: str = "chosen"
) -> DataFrame:
    """All rows plus ``flag``: is the row among the first ``n`` by (hash of key, key)?

    ``key`` must be unique where it is not null. Rows with a null key come last, in
    an order fixed by the whole row; rows equal in full then stay on one side of
    the cut. The rows are neither sorted nor shuffled: slice
    counts tell where row ``n`` lies, that slice alone (one 2**CUT_BITS-th of
    the rows) is ranked, and every row is compared with the cut found there.
    """
    return _flag(df, _slices(df, key, [], seed), F.lit(n), key, seed, flag)


def _take_sliced(
    df: DataFrame, n: int, key: str, by: list[str], seed: int | None, share: int
) -> DataFrame:
    """Up to ``n`` rows of each group (or of all rows).

    Rows of a hot group beyond the slice that holds its n-th row are dropped
    while scanning, and what is left is ranked slice by slice, so a hot group is
    spread over many tasks. Other groups are small and ranked whole.
    """
    slices = _slices(df, key, by, seed)
    edges = _edges(slices, F.lit(n)).select(*by, F.col("_slice").alias("_edge"), "_before")
    rows = df.withColumns(_place(df, key, seed)).withColumn("_slice", _slice(F.col("_h")))
    if by:
        groups = slices.groupBy(*by).agg(F.sum("_n").alias("_n"))
        hot = hot_keys(groups, by, "_n", share).join(edges, by, "left")
        marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), by, "left")
    else:
        edge = edges.select(F.struct("_edge", "_before")).scalar()
        marked = rows.withColumns(
            {"_edge": edge["_edge"], "_before": edge["_before"], "_hot": F.lit(True)}
        )
    near = marked.filter(F.col("_edge").isNull() | (F.col("_slice") <= F.col("_edge")))
    part = F.when(F.col("_hot"), F.col("_slice")).otherwise(-1)
    skip = F.when(F.col("_slice") == F.col("_edge"), F.col("_before")).otherwise(0)
    order = W.partitionBy(*by, "_part").orderBy("_h", key, "_whole")
    ranked = near.withColumns({"_part": part, "_skip": skip}).withColumn(
        "_rank", F.row_number().over(order)
    )
    return ranked.filter(F.col("_rank") + F.col("_skip") <= n).select(*df.columns)


def take_first(
    df: DataFrame,
    n: int,
    *,
    key: str,
    by: Sequence[str] = (),
    seed: int | None = None,
    share: int = HOT_SHARE,
) -> DataFrame:
    """``n`` rows (of each group, if ``by`` is given), repeatable for a key and seed.

    Rows with a null key are taken after all others, in an order fixed by the
    whole row. Rows with a null in ``by`` belong to no group.
    """
    by = list(by)
    return _take_sliced(df.dropna(subset=by) if by else df, n, key, by, seed, share)


def balance_classes(
    df: DataFrame,
    n: int,
    *,
    label: str = "label",
    key: str = "review_id",
    seed: int | None = None,
    classes: Sequence | None = None,
) -> DataFrame:
    """At most ``n`` rows of each class that is present (or of the listed ones)."""
    rows = df.filter(F.col(label).isin(list(classes))) if classes is not None else df
    return take_first(rows, n, key=key, by=[label], seed=seed)


def split_share(
    df: DataFrame, percent: int = 90, *, key: str = "review_id", seed: int | None = None
) -> DataFrame:
    """Column ``split``: about ``percent`` of the rows are train, the others test."""
    name = F.when(bucket(key, 100, seed) < percent, "train").otherwise("test")
    return df.withColumn("split", name)


def split_exact(
    df: DataFrame, test_share: float = 0.2, *, key: str = "review_id", seed: int | None = None
) -> DataFrame:
    """Column ``split`` with exactly ceil(test_share * rows) test rows.

    Rows with a null key come last; if the cut falls among them, rows that are
    equal in full go to one side together.
    """
    slices = _slices(df, key, [], seed)
    n_test = F.ceil(slices.agg(F.sum("_n")).scalar() * F.lit(float(test_share)))
    flagged = _flag(df, slices, n_test, key, seed, "_test")
    return flagged.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def with_fold(
    df: DataFrame, folds: int = 5, *, key: str = "review_id", seed: int | None = 42
) -> DataFrame:
    """Column ``fold``, 0..folds-1, fixed by the key and the seed."""
    return df.withColumn("fold", bucket(key, folds, seed))


def fold_frames(df: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, held-out) rows of fold ``k``."""
    return df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)


def fold_sizes(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Train and held-out row counts of each fold, from one count per fold."""
    counts = df.groupBy(fold).agg(F.count(F.lit(1)).alias("eval_rows"))
    total = counts.agg(F.sum("eval_rows")).scalar()
    return counts.select(fold, (total - F.col("eval_rows")).alias("train_rows"), "eval_rows")
