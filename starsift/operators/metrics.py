"""Evaluation as plain aggregates over (label, prediction) rows.

Class metrics start from the confusion counts: one pass that shrinks any input
to one row per (label, prediction) before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def abs_error(label: str = "label", prediction: str = "prediction") -> Column:
    return F.abs(F.col(prediction) - F.col(label))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def mae(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg(abs_error(label, prediction)).alias("mae"))


def mape(
    df: DataFrame, label: str = "label", prediction: str = "prediction", *, shift: float = 0.0,
    percent: bool = False,
) -> DataFrame:
    """Mean |prediction - label| / (label + shift), as a fraction or in ``percent``.

    ``shift=1`` restores 1-based ratings from 0-based labels. Rows whose
    shifted label is 0 have no percentage error and are left out.
    """
    ratio = F.try_divide(abs_error(label, prediction), F.col(label) + F.lit(float(shift)))
    return df.agg((F.avg(ratio) * (100.0 if percent else 1.0)).alias("mape"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Row counts per (label, prediction)."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(
    df: DataFrame, classes: Sequence, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row per label, one count column per listed class."""
    cells = [
        F.count_if(F.col(prediction) == F.lit(c)).alias(f"pred_{c:g}") for c in classes
    ]
    return df.groupBy(label).agg(*cells)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _class_sums(
    cells: DataFrame, by: list[str], label: str, prediction: str, **extra: Column
) -> DataFrame:
    """Confusion counts as one row per class: support, predicted, hits, precision,
    recall, f1 (0 where undefined) and the sums of ``extra`` over the class's labels.

    Every count enters once for its label and once for its prediction.
    """
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col(label) == F.col(prediction), n).otherwise(zero)
    as_label = {"support": n, "predicted": zero, "hits": hit, **extra}
    as_guess = {"support": zero, "predicted": n, "hits": zero}
    sides = F.array(
        F.struct(
            F.col(label).cast("double").alias("class"),
            *[c.alias(name) for name, c in as_label.items()],
        ),
        F.struct(
            F.col(prediction).cast("double").alias("class"),
            *[as_guess.get(name, F.lit(0.0).cast("double")).alias(name) for name in as_label],
        ),
    )
    sums = cells.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        *[F.sum(name).alias(name) for name in as_label]
    )
    nothing = F.lit(0.0).cast("double")
    p = F.coalesce(_ratio(F.col("hits"), F.col("predicted")), nothing)
    r = F.coalesce(_ratio(F.col("hits"), F.col("support")), nothing)
    rates = sums.withColumns({"precision": p, "recall": r})
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", F.coalesce(_ratio(2 * p * r, p + r), nothing))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Per class: support, predicted, hits, precision, recall, f1 (0 where undefined)."""
    return _class_sums(confusion(df, label, prediction), [], label, prediction)


def _weighted(name: str) -> Column:
    return _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return classification_report(df, label, prediction).agg(_weighted("f1").alias("f1"))


def metric_bundle(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    *,
    by: Sequence[str] = (),
    shift: float = 0.0,
    percent: bool = False,
) -> DataFrame:
    """accuracy, weighted f1, mae and mape in one pass, per group if ``by`` is given.

    ``shift`` and ``percent`` as in ``mape``.
    """
    by = list(by)
    cells = df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("n"))
    n, err = F.col("n").cast("double"), abs_error(label, prediction).cast("double")
    rel = F.try_divide(err, (F.col(label) + F.lit(float(shift))).cast("double"))
    none = F.lit(0.0).cast("double")
    classes = _class_sums(
        cells, by, label, prediction,
        _err=err * n, _rel=F.coalesce(rel * n, none), _known=F.when(rel.isNotNull(), n).otherwise(none),
    )
    return classes.groupBy(*by).agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        _weighted("f1").alias("f1"),
        _ratio(F.sum("_err"), F.sum("support")).alias("mae"),
        (_ratio(F.sum("_rel"), F.sum("_known")) * (100.0 if percent else 1.0)).alias("mape"),
    )


def mean_over_folds(
    metrics: DataFrame, *, grid: str = "grid_id", values: Sequence[str] = ("accuracy",)
) -> DataFrame:
    """Mean of each metric over the folds of a grid point."""
    return metrics.groupBy(grid).agg(
        F.count(F.lit(1)).alias("folds"), *[F.avg(v).alias(v) for v in values]
    )


def best_point(means: DataFrame, *, grid: str = "grid_id", metric: str = "accuracy") -> DataFrame:
    """The grid point with the largest metric; the lowest id wins a tie."""
    return means.orderBy(F.col(metric).desc_nulls_last(), F.col(grid)).limit(1)
