import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starsift.operators import dictionary, wordvectors

SCHEMA = "review_id long, tokens array<string>"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [(1, ["b", "a", "a"]), (2, None), (3, []), (4, ["é", "b", None, "b"]), (5, ["c"]), (6, ["b"])]


def test_dictionary_ids_are_gapless(spark):
    many = [(i, [f"w{j:03d}" for j in range(i % 97)]) for i in range(300)]
    n = Counter(t for _, tokens in many for t in tokens)
    want = {t: (c, i) for i, (t, c) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0])))}
    got = {r.term: (r.df, r.id) for r in dictionary.vocabulary(docs(spark, many)).collect()}
    assert got == want
    plan = dictionary.vocabulary(docs(spark, many))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_count_vectors(spark):
    rows = {r.review_id: (r.indices, r.counts) for r in dictionary.count_vectors(docs(spark, ODD)).collect()}
    assert rows == {1: ([0, 1], [1, 2]), 2: ([], []), 3: ([], []), 4: ([0, 3], [2, 1]), 5: ([2], [1]), 6: ([0], [1])}
    rows = {r.review_id: (r.indices, r.counts) for r in dictionary.count_vectors(docs(spark, ODD), min_df=2).collect()}
    assert rows[4] == ([0], [2]) and rows[5] == ([], [])
    assert dictionary.count_vectors(docs(spark, ODD).limit(0)).collect() == []


def test_pairs_are_those_of_a_window(spark):
    rows = [(1, [0, 1, 2, 1]), (2, [5]), (3, []), (4, [1, 1])]
    want = Counter()
    for _, ids in rows:
        for i, a in enumerate(ids):
            want.update((a, ids[j]) for j in range(max(0, i - 2), min(len(ids), i + 3)) if j != i)
    got = wordvectors.pair_counts(spark.createDataFrame(rows, "review_id long, ids array<long>"), 2).collect()
    assert {(r.centre, r.context): r.n for r in got} == want


@pytest.mark.parametrize("block_words", [8192, 9])
def test_words_of_a_topic_are_near(spark, block_words):
    draw = random.Random(3)
    topics = [[f"{t}{i}" for i in range(12)] for t in "xyz"]
    rows = [(i, [draw.choice(topics[i % 3]) for _ in range(20)]) for i in range(240)] + [(900, None), (901, []), (902, ["rare"])]
    how = {"size": 12, "epochs": 6, "block_words": block_words}
    found = wordvectors.train(docs(spark, rows), **how).orderBy("id").collect()
    assert [r.id for r in found] == list(range(36)) and {len(r.v) for r in found} == {12}
    x = np.array([r.v for r in found])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    topic = np.array([r.term[0] for r in found])
    nearest = np.argsort(-(x @ x.T - 2 * np.eye(len(x))), axis=1)[:, :5]
    assert (topic[nearest] == topic[:, None]).mean() > 0.9
    again = wordvectors.train(docs(spark, rows).repartition(2), **how).orderBy("id").collect()
    assert np.allclose([r.v for r in again], [r.v for r in found], atol=1e-5)


def test_document_vectors_are_means(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, -1.0])], "term string, v array<double>")
    rows = wordvectors.document_vectors(docs(spark, ODD), vectors, 2).collect()
    want = {1: [2.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [2.0, -0.5], 5: [0.0, 0.0], 6: [4.0, -1.0]}
    assert {r.review_id: r.embedding for r in rows} == want


def test_no_words(spark):
    empty = docs(spark, [(1, None), (2, ["one"])])
    assert wordvectors.train(empty, size=4).collect() == []
    model = wordvectors.SkipGram(inputCol="tokens", outputCol="f").with_settings("review_id", size=4).fit(empty)
    assert [r.f.toArray().tolist() for r in model.transform(empty).select(F.col("f")).collect()] == [[0.0] * 4] * 2


@pytest.mark.parametrize("most", [0, 100])
def test_document_vectors_by_table_or_join(spark, monkeypatch, most):
    monkeypatch.setattr(wordvectors, "MAX_BROADCAST_VALUES", most)
    table = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0])], "term string, v array<double>")
    found = wordvectors.document_vectors(docs(spark, ODD), table, 2)
    got = {r.review_id: r.embedding for r in found.collect()}
    assert got == {1: [2.5 / 3, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.25, -0.5], 5: [0.0, 0.0], 6: [0.5, -1.0]}
    assert ("Union" in found._jdf.queryExecution().optimizedPlan().toString()) == (most == 0)


def test_token_ids_keep_order_and_repeats(spark):
    ids = spark.createDataFrame([("a", 7, 1), ("b", 2, 3)], "term string, id long, df long")
    found = wordvectors.token_ids(docs(spark, ODD), ids, key="review_id", tokens="tokens")
    assert {r.review_id: r.ids for r in found.collect()} == {1: [2, 7, 7], 4: [2, 2], 6: [2]}
    assert "map_from_entries" not in found._jdf.queryExecution().analyzed().toString()
    with pytest.raises(Exception, match="documents with the same key"):
        wordvectors.token_ids(docs(spark, ODD * 2), ids, key="review_id", tokens="tokens").collect()
