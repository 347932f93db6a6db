"""Metrics over (label, prediction) rows, fold means, grid reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from starsift.catalog.fixtures import view
from starsift.catalog.registry import query
from starsift.catalog.relational import kfold_sizes, sql_hash
from starsift.operators import metrics, models, setops

CLASSES_SQL = """cells as (select {by} label, prediction, count(*) as n from predictions group by all),
    sides as (select {by} label as class, n as support, 0 as predicted,
                     case when label = prediction then n else 0 end as hits from cells
              union all select {by} prediction, 0, n, 0 from cells),
    sums as (select {by} class, sum(support)::bigint as support, sum(predicted)::bigint as predicted,
                    sum(hits)::bigint as hits from sides group by all),
    pr as (select *, case when predicted > 0 then hits::double / predicted else 0 end as precision,
                  case when support > 0 then hits::double / support else 0 end as recall from sums),
    report as (select *, case when precision + recall > 0
                 then 2 * precision * recall / (precision + recall) else 0::double end as f1 from pr)"""

ONE = CLASSES_SQL.format(by="")
GRID = CLASSES_SQL.format(by="grid_id, fold,")
BASICS_SQL = """basics as (select grid_id, fold,
    avg(case when label = prediction then 1 else 0 end) as accuracy,
    avg(abs(prediction - label)) as mae,
    avg(abs(prediction - label) / nullif(label, 0)) as mape from predictions group by grid_id, fold),
  folds as (select grid_id, fold, accuracy, f1, mae, mape from basics join
    (select grid_id, fold, sum(f1 * support) / sum(support) as f1 from report group by grid_id, fold) w
    using (grid_id, fold))"""


def predictions(spark, sf_dir):
    return view(spark, sf_dir, "predictions")


def fold_metrics(spark, sf_dir):
    return metrics.metric_bundle(predictions(spark, sf_dir), by=["grid_id", "fold"])


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(
    "abs_error",
    "select review_id, abs(prediction - label) as abs_error from predictions",
    ("predictions",),
)
def abs_error(spark, sf_dir):
    return predictions(spark, sf_dir).select("review_id", metrics.abs_error().alias("abs_error"))


@query(
    "accuracy",
    "select round(avg(case when label = prediction then 1 else 0 end), 6) as accuracy from predictions",
    ("predictions",),
)
def accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(predictions(spark, sf_dir)), "accuracy")


@query(
    "mae", "select round(avg(abs(prediction - label)), 6) as mae from predictions", ("predictions",)
)
def mae(spark, sf_dir):
    return _rounded(metrics.mae(predictions(spark, sf_dir)), "mae")


@query(
    "mape",
    """select round(avg(abs(prediction - label) / nullif(label, 0)), 6) as mape from predictions""",
    ("predictions",),
)
def mape(spark, sf_dir):
    return _rounded(metrics.mape(predictions(spark, sf_dir)), "mape")


@query(
    "mape_percent",
    "select round(avg(abs(prediction - label) / nullif(label, 0)) * 100, 4) as mape from predictions",
    ("predictions",),
)
def mape_percent(spark, sf_dir):
    return metrics.mape(predictions(spark, sf_dir), percent=True).select(F.round("mape", 4).alias("mape"))


@query(
    "metric_bundle_zero_based",
    f"""with {GRID} select grid_id, round(max(accuracy), 6) as accuracy, round(max(f1), 6) as f1,
          round(max(mae), 6) as mae, round(max(mape), 6) as mape from
          (select grid_id, avg(case when label = prediction then 1 else 0 end) as accuracy, null as f1,
             avg(abs(prediction - label)) as mae, avg(abs(prediction - label) / label) as mape
           from predictions group by grid_id
           union all select grid_id, null, sum(f1 * support) / sum(support), null, null from
             (select grid_id, class, support, case when precision + recall > 0
                then 2 * precision * recall / (precision + recall) else 0::double end as f1 from
               (select grid_id, class, sum(support) as support,
                  case when sum(predicted) > 0 then sum(hits)::double / sum(predicted) else 0 end as precision,
                  case when sum(support) > 0 then sum(hits)::double / sum(support) else 0 end as recall
                from sums group by grid_id, class) r) s
           group by grid_id) x group by grid_id""",
    ("predictions",),
)
def metric_bundle_zero_based(spark, sf_dir):
    """Labels and predictions counted from 0, as class indices are; relative errors on the ratings."""
    zero_based = predictions(spark, sf_dir).withColumns({c: F.col(c) - 1 for c in ("label", "prediction")})
    rows = metrics.metric_bundle(zero_based, by=["grid_id"], shift=1.0)
    return _rounded(rows, "accuracy", "f1", "mae", "mape")


@query(
    "weighted_f1",
    f"with {ONE} select round(sum(f1 * support) / sum(support), 6) as f1 from report",
    ("predictions",),
)
def weighted_f1(spark, sf_dir):
    return _rounded(metrics.weighted_f1(predictions(spark, sf_dir)), "f1")


@query(
    "metric_bundle",
    f"""with {ONE} select
          round((select avg(case when label = prediction then 1 else 0 end) from predictions), 6) as accuracy,
          round((select sum(f1 * support) / sum(support) from report), 6) as f1,
          round((select avg(abs(prediction - label)) from predictions), 6) as mae,
          round((select avg(abs(prediction - label) / nullif(label, 0)) from predictions), 6) as mape""",
    ("predictions",),
)
def metric_bundle(spark, sf_dir):
    return _rounded(
        metrics.metric_bundle(predictions(spark, sf_dir)), "accuracy", "f1", "mae", "mape"
    )


@query(
    "confusion_matrix",
    "select label, prediction, count(*) as n from predictions group by label, prediction",
    ("predictions",),
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


@query(
    "confusion_matrix_wide",
    "select label, "
    + ", ".join(f"count(*) filter (prediction = {c}) as pred_{c}" for c in range(1, 6))
    + " from predictions group by label",
    ("predictions",),
)
def confusion_matrix_wide(spark, sf_dir):
    return metrics.confusion_wide(predictions(spark, sf_dir), [1.0, 2.0, 3.0, 4.0, 5.0])


@query(
    "classification_report",
    f"""with {ONE} select class, support, predicted, hits, round(precision, 6) as precision,
          round(recall, 6) as recall, round(f1, 6) as f1 from report""",
    ("predictions",),
)
def classification_report(spark, sf_dir):
    report = metrics.classification_report(predictions(spark, sf_dir))
    return _rounded(report, "precision", "recall", "f1")


@query(
    "fold_metric_mean",
    f"""with {GRID}, {BASICS_SQL} select grid_id, count(*) as folds, round(avg(accuracy), 6) as accuracy,
          round(avg(f1), 6) as f1, round(avg(mae), 6) as mae, round(avg(mape), 6) as mape
        from folds group by grid_id""",
    ("predictions",),
)
def fold_metric_mean(spark, sf_dir):
    names = ["accuracy", "f1", "mae", "mape"]
    means = metrics.mean_over_folds(fold_metrics(spark, sf_dir), values=names)
    return _rounded(means, *names)


@query(
    "best_grid_point",
    f"""with {GRID}, {BASICS_SQL} select grid_id, folds, round(accuracy, 6) as accuracy,
          round(mae, 6) as mae from
          (select grid_id, count(*) as folds, avg(accuracy) as accuracy, avg(mae) as mae
           from folds group by grid_id) x order by x.accuracy desc, grid_id limit 1""",
    ("predictions",),
)
def best_grid_point(spark, sf_dir):
    means = metrics.mean_over_folds(fold_metrics(spark, sf_dir), values=["accuracy", "mae"])
    return _rounded(metrics.best_point(means), "accuracy", "mae")


GRIDS = {
    "mlp": models.MLP_GRID,
    "forest": models.FOREST_GRID,
    "lstm": models.LSTM_GRID,
    "transformer": models.TRANSFORMER_GRID,
}


def _grid_sql(name: str, grid: dict) -> str:
    """Text 'p=v,...' of every grid point of a model, with the fold sizes."""
    froms = ", ".join(
        f"(select unnest([{', '.join(repr(str(v)) for v in values)}]) as {p}) g_{p}"
        for p, values in grid.items()
    )
    text = " || ',' || ".join(f"'{p}=' || {p}" for p in grid)
    return f"select '{name}' as model, {text} as params, fold, train_rows, eval_rows from sizes, {froms}"


@query(
    "param_grid",
    f"""with f as (select cast({sql_hash('review_id', 42)} % 5 as integer) as fold from reviews),
        sizes as (select k as fold, count(*) filter (fold <> k) as train_rows,
                         count(*) filter (fold = k) as eval_rows
                  from f, (select distinct fold as k from f) g group by k) """
    + " union all ".join(_grid_sql(name, grid) for name, grid in GRIDS.items()),
    ("reviews",),
)
def param_grid(spark, sf_dir):
    """Every fit of the four grid searches: point, fold and the rows it trains on."""
    sizes = kfold_sizes(spark, sf_dir)

    def fits(name, grid):
        texts = {p: [str(v) for v in values] for p, values in grid.items()}
        point = F.concat_ws(",", *[F.concat(F.lit(f"{p}="), F.col(p)) for p in grid])
        return models.explode_grid(sizes, texts).select(
            F.lit(name).alias("model"), point.alias("params"), "fold", "train_rows", "eval_rows"
        )

    return setops.union_all([fits(name, grid) for name, grid in GRIDS.items()])
