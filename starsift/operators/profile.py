"""Null profile and null/row-quality filters."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_counts(df: DataFrame) -> list[Column]:
    """Per column the number of NULL (for floating types also NaN) values, as aggregates."""

    def missing(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            return c.isNull() | F.isnan(c)
        return c.isNull()

    return [F.count_if(missing(f)).alias(f.name) for f in df.schema.fields]


def null_profile(df: DataFrame) -> DataFrame:
    """One row: per column the number of NULL (for floating types also NaN) values."""
    return df.agg(*missing_counts(df))


@dataclass
class Written:
    """A written frame, read back, with what was counted on the way and the seconds it took."""

    rows: DataFrame
    n_rows: int
    missing: dict[str, int]
    seconds: float

    def profile(self) -> DataFrame:
        """``null_profile`` of the rows, from the counts."""
        fields = ", ".join(f"`{name}` bigint" for name in self.missing)
        return self.rows.sparkSession.createDataFrame([tuple(self.missing.values())], fields)


def write_profiled(df: DataFrame, path: str) -> Written:
    """Write ``df`` as Parquet and count rows and missing values in the same job.

    The counts ride on the write (``observe``) in its last stage, where a task counts
    once however often it is tried, so no second scan is needed. The time is that of the
    forced write, not of planning.
    """
    seen = Observation()
    counts = [F.struct(*missing_counts(df)).alias("missing"), F.count(F.lit(1)).alias("n_rows")]
    start = time.monotonic()
    df.observe(seen, *counts).write.parquet(path)
    seconds = time.monotonic() - start
    found = seen.get
    missing = found["missing"].asDict()
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return Written(rows, int(found["n_rows"]), {c: int(missing[c]) for c in df.columns}, seconds)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null (or NaN) in ``subset`` (default: all columns)."""
    return df.dropna("any", subset=list(subset) if subset else None)


def min_length(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Rows whose text has at least ``n`` characters."""
    return df.filter(F.length(column) >= n)


def as_missing(df: DataFrame, na_values: Sequence[str]) -> DataFrame:
    """Turn the listed texts into null in every string column."""
    words = list(na_values)
    return df.select(
        *[
            F.when(~F.col(f.name).isin(words), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
