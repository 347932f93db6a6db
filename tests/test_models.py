import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from starsift.catalog import QUERIES, modelling
from starsift.operators import models, sampling
from starsift.plans import flows


@pytest.fixture(scope="module")
def labelled(spark):
    """Two classes told apart by their words, plus noise; 'b' is rarer."""
    rng = random.Random(4)
    own = {"a": ["sun", "sea", "sand"], "b": ["code", "bug", "test"]}
    data = []
    for i in range(240):
        label = "b" if i % 3 == 0 else "a"
        words = [rng.choice(own[label]) for _ in range(6)] + [rng.choice(["x", "y"]) for _ in range(3)]
        data.append((i, " ".join(words), label))
    df = spark.createDataFrame(data, "review_id long, text string, label string")
    df = sampling.with_fold(sampling.split_share(df, 80), 3)
    indexer = models.label_stage().fit(df)
    return indexer.transform(df).repartition(3), indexer.labels


def test_cross_validation(spark, labelled):
    df, _ = labelled
    train = df.filter("split = 'train'")
    tuned = models.cross_validate(
        train, models.tfidf_stages(n=32), models.perceptron(32, 3, hidden=[8]),
        {"maxIter": [1, 30]}, folds=3, parallelism=2,
    )
    rows = tuned.metrics.collect()
    assert [(r.grid_id, r.fold) for r in rows] == [(g, f) for g in (0, 1) for f in (0, 1, 2)]
    means = {r.grid_id: r.accuracy for r in tuned.means.collect()}
    best = max(means, key=lambda g: (means[g], -g))
    assert tuned.best_id == best and tuned.best_params == [{"maxIter": 1}, {"maxIter": 30}][best]
    assert means[best] > 0.9
    scored = models.score(tuned.model, df.filter("split = 'test'"), ["a", "b", "unseen"])
    assert scored.filter("predicted_label = label").count() / scored.count() > 0.9
    params = {r.name: r.value for r in tuned.best_param_frame(spark).collect()}
    assert params["maxIter"] == str(tuned.best_params["maxIter"])


@pytest.mark.parametrize("network", [True, False])
def test_a_stopped_search_goes_on(spark, labelled, tmp_path, monkeypatch, network):
    df, _ = labelled
    if network:
        search = (models.tfidf_stages(n=16), models.perceptron(16, 3, hidden=[4]), {"maxIter": [4, 10, 6], "blockSize": [32, 64]})
        how = {"folds": 3, "segment": 4, "parallelism": 2}
    else:
        search = (models.tfidf_stages(n=16), models.forest(), {"numTrees": [2, 3], "maxDepth": [2, 3]})
        how = {"folds": 3, "parallelism": 2}
    kind = type(search[1])
    whole = models.cross_validate(df, *search, **how, ledger=str(tmp_path / "whole"))
    fit, fits = kind.fit, []

    def stopping(limit):
        def run(self, *args):
            if len(fits) >= limit:
                raise KeyError("stopped")
            fits.append(1)
            return fit(self, *args)
        return run

    path = str(tmp_path / "stopped")
    monkeypatch.setattr(kind, "fit", stopping(5))
    with pytest.raises(KeyError):
        models.cross_validate(df, *search, **how, ledger=path)
    monkeypatch.setattr(kind, "fit", stopping(10**6))
    resumed = models.cross_validate(df, *search, **how, ledger=path)
    assert resumed.metrics.collect() == whole.metrics.collect() and resumed.best_params == whole.best_params
    # A segment is fitted once: iterations 4, 6, 8 and 10 of both block sizes; the refit comes on top.
    refit = -(-resumed.best_params["maxIter"] // 4) if network else 1
    assert len(fits) == 3 * (2 * 4 if network else 4) + refit
    fits.clear()
    models.cross_validate(df, *search, **how, ledger=path)
    assert len(fits) == refit
    fits.clear()
    models.cross_validate(df.where("review_id <> 7"), *search, **how, ledger=path)
    assert len(fits) > refit


def test_segments_go_on_from_saved_weights(labelled):
    df, _ = labelled
    clf = models.perceptron(16, 3, hidden=[4], max_iter=9)
    model = models.fit_classifier(df, models.tfidf_stages(n=16), clf, segment=4).stages[-1]
    assert model.getOrDefault("maxIter") == 9 and not model.isSet(model.initialWeights)


def test_features_are_fitted_on_training_rows_only(labelled):
    df, _ = labelled
    train = df.filter("fold = 0")
    model = Pipeline(stages=models.tfidf_stages(n=32)).fit(train)
    assert model.stages[-1].numDocs == train.count()


def test_forest_on_word_vectors(labelled):
    df, _ = labelled
    stages = models.word2vec_stages(size=8, min_count=1, epochs=3)
    tuned = models.cross_validate(
        df, stages, models.forest(numTrees=5), {"maxDepth": [2, 4]}, folds=3
    )
    assert max(r.accuracy for r in tuned.means.collect()) > 0.9


def test_grids_have_the_published_sizes():
    sizes = [len(models.grid_points(g)) for g in
             (models.MLP_GRID, models.FOREST_GRID, models.LSTM_GRID, models.TRANSFORMER_GRID)]
    assert sizes == [48, 27, 486, 180]
    assert len(models.grid_points(models.MLP_TUNING_GRID)) == 12
    maps = models.param_maps(models.forest(), models.FOREST_GRID)
    assert {p.name: v for p, v in maps[-1].items()} == {"maxDepth": 15, "numTrees": 150, "maxBins": 64}


def test_model_queries(spark, sf_dir):
    docs = modelling.labelled_docs(spark, sf_dir)
    test = docs.filter("split = 'test'")
    for name in ("mlp_predict", "rf_predict"):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert len(rows) == test.count()
        assert all(abs(r.probability_sum - 1) < 1e-6 for r in rows)
        hits = sum(r.label == r.predicted_label for r in rows)
        assert hits / len(rows) > 0.7, name
    same = QUERIES["model_roundtrip"](spark, sf_dir)
    assert same.filter("before <> after").count() == 0 and same.count() == test.count()


def test_feature_queries(spark, sf_dir):
    n = modelling.labelled_docs(spark, sf_dir).count()
    tf = QUERIES["hashing_tf"](spark, sf_dir).collect()
    assert len(tf) == n and all(r.n_tokens == r.tf_sum and r.buckets_used <= 200 for r in tf)
    vectors = QUERIES["word2vec_doc"](spark, sf_dir).collect()
    assert len(vectors) == n and {len(r.embedding) for r in vectors} == {100}


def test_prepared_flow(spark):
    data = [
        ("r%d" % i, i % 4, i % 3, "Head", "<b>good</b> thing number text %d" % (i % 2), 1 + i % 5)
        for i in range(60)
    ] + [("lonely", 99, 98, "Head", "a text that is long enough", 1),
         ("short", 0, 0, "Head", "tiny", 1), ("null", 0, 0, None, "a text that is long enough", 1)]
    schema = ("review_id string, customer_id long, product_id long, review_headline string, "
              "review_body string, star_rating int")
    df = spark.createDataFrame(data, schema)
    out = flows.prepare_reviews(df, min_df=21)
    ids = {r.review_id for r in out.collect()}
    assert ids == {"r%d" % i for i in range(60)}
    assert out.filter(F.col("review").contains("<")).count() == 0
    folded = flows.balanced_folds(out.withColumnRenamed("star_rating", "label"), 10)
    assert folded.count() == 50 and {"split", "fold"} <= set(folded.columns)


def test_null_vectors_and_unseen_classes(spark):
    from starsift.functions.vectors import dense

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, x array<double>")
    sums = models.batch_score("x", lambda m: m.sum(axis=1), "double")
    scores = dense("x", [([[1.0], [1.0]], [0.5], "linear")])
    assert sorted(map(tuple, df.select("id", sums, scores).collect())) == [(1, 3.0, [3.5]), (2, None, None)]

    class Fixed:
        def transform(self, frame):
            return frame.selectExpr("*", "cast(id as double) as prediction")

    named = models.score(Fixed(), df, ["a", "b"]).collect()
    assert {r.id: r.predicted_label for r in named} == {1: "b", 2: None}


def test_fits_read_partitions_of_their_own_rows(spark, labelled, monkeypatch):
    df, _ = labelled
    seen = []
    fit = models.MultilayerPerceptronClassifier.fit

    def noted(self, rows, *more):
        seen.append(rows.rdd.getNumPartitions())
        return fit(self, rows, *more)

    monkeypatch.setattr(models.MultilayerPerceptronClassifier, "fit", noted)
    network = models.perceptron(32, 3, hidden=[8], max_iter=2)
    models.fit_classifier(df.repartition(40), models.tfidf_stages(n=32), network)
    models.cross_validate(df.repartition(40), models.tfidf_stages(n=32), network, {"blockSize": [64]}, folds=3, refit=False)
    assert seen == [1] * 4
    assert [models._partitions(n, 12) for n in (0, 1, 5_000, 25_000, 10_000_000)] == [1, 1, 5, 12, 100]
