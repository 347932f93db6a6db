import random

import pytest
from pyspark.sql import functions as F

from starsift.functions import text as tx
from starsift.operators import dictionary, models
from starsift.plans import flows

WORDS = {1: "awful broken refund", 3: "average plain okay", 5: "lovely great perfect"}


@pytest.fixture(scope="module")
def reviews(spark):
    """Ratings told by their words; a short text, a repeated row and nulls among them."""
    rng = random.Random(11)
    data = []
    for i in range(300):
        star = rng.choice([1, 3, 5])
        text = " ".join(rng.choice(WORDS[star].split()) for _ in range(8))
        data.append((f"c{i % 6}", f"r{i}", f"p{i % 5}", "head", f"<b>{text}</b>", star))
    data += [("c1", "short", "p1", "head", "ok", 5), ("c1", "none", "p1", None, None, 3)]
    schema = "customer_id string, review_id string, product_id string, review_headline string, review_body string, star_rating int"
    return spark.createDataFrame(data, schema).repartition(3)


def test_notebook_features(spark, reviews):
    rows = flows.notebook_features(reviews.unionAll(reviews.limit(3)), min_doc_freq=60, max_per_pair=100).collect()
    assert len({r.review_id for r in rows}) == len(rows) == 300
    assert all("<" not in r.review and r.review.startswith("head ") for r in rows)
    for r in rows:
        words = r.review.lower().split()
        assert sum(r.counts) == len(words) and len(r.indices) == len(set(words)) == len(r.weights)
        assert list(r.indices) == sorted(r.indices) and r.indices[0] == 0
        assert r.weights[0] == 0.0  # "head" is in every review
    assert flows.notebook_features(reviews.limit(0)).collect() == []


def test_rare_terms_keep_their_place(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "")], "review_id long, t string")
    df = df.select("review_id", F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(tx.whitespace_tokens("t")).alias("tokens"))
    got = {r.review_id: r for r in dictionary.tfidf_vectors(df, min_doc_freq=2).collect()}
    assert got[3].indices == [] == got[3].weights
    assert got[1].indices == [0, 1] and got[1].counts == [1, 2]
    assert got[1].weights == pytest.approx([0.28768207, 0.0]) and got[2].indices == [0, 2]


def test_network_flow(spark, reviews, tmp_path):
    settings = {"per_class": 60, "grid": {"maxIter": [4, 30]}, "width": 32, "hidden": [8], "folds": 3, "segment": 10}
    done = flows.tfidf_network(reviews, **settings, ledger=str(tmp_path / "ledger"))
    rows = flows.tfidf_rows(reviews, per_class=60).collect()
    assert max(sum(r.label == c for r in rows) for c in (1, 3, 5)) == 60 and len(rows) == 180
    test = {r.review_id: r.label for r in rows if r.split == "test"}
    guessed = done.predictions.collect()
    assert {r.review_id: r.label for r in guessed} == test
    assert {r.prediction for r in guessed} <= {1.0, 3.0, 5.0}
    got = done.metrics.first()
    n = len(guessed)
    assert got.n_test == n and got.accuracy == sum(r.label == r.prediction for r in guessed) / n > 0.9
    assert got.mae == pytest.approx(sum(abs(r.label - r.prediction) for r in guessed) / n)
    assert got.mape == pytest.approx(100 * sum(abs(r.label - r.prediction) / r.label for r in guessed) / n)
    assert done.tuned.best_params in ({"maxIter": 4}, {"maxIter": 30}) and min(done.seconds.values()) > 0


def test_forest_flow(spark, reviews):
    done = flows.word_vector_forest(
        reviews, train_per_class=60, test_per_class=15, grid={"numTrees": [3, 5]}, size=8, folds=2,
    )
    rows = flows.word_vector_rows(reviews, train_per_class=60, test_per_class=15).collect()
    sizes = {(s, c): sum(r.split == s and r.label == c for r in rows) for s in ("train", "test") for c in (0, 2, 4)}
    assert all(n <= (60 if s == "train" else 15) for (s, _), n in sizes.items())
    guessed = done.predictions.collect()
    assert {r.review_id for r in guessed} == {r.review_id for r in rows if r.split == "test"}
    got = done.metrics.first()
    want = sum(abs(r.label - r.prediction) / (r.label + 1) for r in guessed) / len(guessed)
    assert got.mape == pytest.approx(want) and got.accuracy > 0.5


def test_a_class_of_the_test_rows_alone_is_an_error(spark, reviews):
    rows = flows.tfidf_rows(reviews, per_class=40)
    train, test = rows.filter("label <> 5"), rows.filter("label = 5")
    done = flows.tune_and_score(
        train, test, models.tfidf_stages(n=16), lambda units: models.perceptron(16, units, hidden=[4]),
        {"maxIter": [5]}, folds=2, fold="fold",
    )
    assert done.metrics.first().accuracy == 0.0 and done.predictions.filter("label <> 5").count() == 0


def test_flows_build_their_rows_once(spark, reviews):
    """The capped and the cleaned rows are read back, not made again by each later step."""
    dense = flows.dense_reviews(reviews, max_per_pair=100)
    assert "Window" not in dense._jdf.queryExecution().optimizedPlan().toString()
    rows = flows.word_vector_rows(reviews, train_per_class=60, test_per_class=15)
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
