import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

from starsift.operators import metrics


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    data = []
    for _ in range(500):
        label = float(rng.choice([1, 1, 1, 2, 3, 5]))
        guess = label if rng.random() < 0.6 else float(rng.choice([1, 2, 4, 5]))
        data.append((label, guess, rng.randrange(3), rng.randrange(2)))
    return spark.createDataFrame(data, "label double, prediction double, grid_id int, fold int"), data


def test_metrics_match_mllib(scored):
    df, data = scored
    row = metrics.metric_bundle(df).first()
    multi = MulticlassClassificationEvaluator()
    accuracy = multi.evaluate(df, {multi.metricName: "accuracy"})
    f1 = multi.evaluate(df, {multi.metricName: "f1"})
    mae = RegressionEvaluator(metricName="mae").evaluate(df)
    mape = sum(abs(p - x) / x for x, p, *_ in data) / len(data)
    for name, want in (("accuracy", accuracy), ("f1", f1), ("mae", mae), ("mape", mape)):
        assert abs(row[name] - want) < 1e-9, name
    assert abs(metrics.accuracy(df).first().accuracy - accuracy) < 1e-9
    assert abs(metrics.weighted_f1(df).first().f1 - f1) < 1e-9
    assert abs(metrics.mae(df).first().mae - mae) < 1e-9
    assert abs(metrics.mape(df).first().mape - mape) < 1e-9


def test_report_has_classes_seen_on_one_side_only(scored):
    df, data = scored
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert set(report) == {1.0, 2.0, 3.0, 4.0, 5.0}
    assert report[4.0].support == 0 and report[4.0].recall == 0 and report[4.0].f1 == 0
    assert report[3.0].support == sum(x == 3 for x, *_ in data)
    wide = {r.label: r for r in metrics.confusion_wide(df, [1.0, 2.0, 4.0, 5.0]).collect()}
    assert wide[1.0].pred_1 == sum(x == p == 1 for x, p, *_ in data)


def test_label_zero_has_no_percentage_error(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "label double, prediction double")
    assert metrics.mape(df).first().mape == 0.5
    assert metrics.metric_bundle(df).first().mape == 0.5
    shifted = metrics.mape(df, shift=1).first().mape
    assert abs(shifted - (1 / 1 + 1 / 3) / 2) < 1e-12


def test_bundle_per_fold_and_means(scored):
    df, data = scored
    per_fold = metrics.metric_bundle(df, by=["grid_id", "fold"])
    rows = per_fold.collect()
    assert len(rows) == 6
    for r in rows:
        part = [(x, p) for x, p, g, f in data if (g, f) == (r.grid_id, r.fold)]
        assert abs(r.accuracy - sum(x == p for x, p in part) / len(part)) < 1e-12
    means = metrics.mean_over_folds(per_fold, values=["accuracy", "mae"])
    for m in means.collect():
        own = [r.accuracy for r in rows if r.grid_id == m.grid_id]
        assert m.folds == 2 and abs(m.accuracy - sum(own) / 2) < 1e-12


def test_first_point_wins_a_tie(spark):
    df = spark.createDataFrame([(2, 0.5), (1, 0.7), (0, 0.7), (3, None)], "grid_id int, accuracy double")
    assert metrics.best_point(df).first().grid_id == 0


def test_empty_input(spark):
    df = spark.createDataFrame([], "label double, prediction double")
    row = metrics.metric_bundle(df).first()
    assert row.accuracy is None and row.f1 is None


def test_percent_and_zero_based_labels(spark):
    rated = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0), (5.0, 5.0)], "label double, prediction double")
    zero = rated.selectExpr("label - 1 as label", "prediction - 1 as prediction")
    want = (1 / 1 + 0 + 1 / 4 + 0) / 4
    assert metrics.mape(rated, percent=True).first().mape == pytest.approx(100 * want)
    assert metrics.mape(zero, shift=1.0).first().mape == pytest.approx(want)
    a, b = (metrics.metric_bundle(df, shift=s, percent=True).first() for df, s in ((rated, 0.0), (zero, 1.0)))
    assert tuple(a) == pytest.approx(tuple(b)) and a.mape == pytest.approx(100 * want)
