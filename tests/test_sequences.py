import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starsift.functions.vectors import argmax, dense, pad_to, softmax
from starsift.operators import sequence, subwords


@pytest.fixture(scope="module")
def vocab(spark):
    pieces = subwords.SPECIAL_PIECES + [
        "un", "##aff", "##able", "##a", "##b", "a", "b", "the", "##e", "aff", "!", "ete",
    ]
    return spark.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, id int")


TEXTS = ["The unaffable THE!", "ab ba xyz", "", "été", "a" * 100, "a" * 101, "abab? the"]


def test_greedy_pieces(vocab):
    ids = {r.piece: r.id for r in vocab.collect()}
    assert subwords.greedy_pieces("unaffable", ids, 1) == [ids["un"], ids["##aff"], ids["##able"]]
    assert subwords.greedy_pieces("unz", ids, 1) == [1]


@pytest.mark.parametrize("max_length", [None, 6])
def test_encoders_agree(spark, vocab, max_length):
    texts = [*TEXTS, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ids = {r.piece: r.id for r in vocab.collect()}

    def run(**kwargs):
        out = subwords.wordpiece_encode(df, vocab, max_length=max_length, **kwargs)
        return {r.doc_id: r.input_ids for r in out.collect()}

    in_tasks = run()
    for share in (1, 10_000):
        assert run(max_broadcast=0, share=share) == in_tasks
    words = [["the", "unaffable", "the", "!"], ["ab", "ba", "xyz"], [], ["ete"],
             ["a" * 100], ["a" * 101], ["abab", "?", "the"], []]
    for i, line in enumerate(words):
        body = [p for w in line for p in subwords.greedy_pieces(w, ids, 1)]
        body = body if max_length is None else body[: max_length - 2]
        assert in_tasks[i] == [2, *body, 3]
    assert in_tasks[5] == [2, 1, 3]


def test_repeated_keys_and_pieces(spark, vocab):
    df = spark.createDataFrame([(1, "the a"), (1, "b"), (None, "the b"), (None, None)], "doc_id long, text string")
    twice = vocab.union(spark.createDataFrame([("the", 77)], "piece string, id int"))
    ways = [sorted(r.input_ids for r in subwords.wordpiece_encode(df, twice, **how).collect())
            for how in ({}, {"max_broadcast": 0}, {"max_broadcast": 0, "share": 1})]
    assert ways[0] == ways[1] == ways[2] == [[2, 3], [2, 11, 3], [2, 77, 10, 3], [2, 77, 11, 3]]


def test_frequency_vocabulary(spark):
    df = spark.createDataFrame([("the cat the dog",), ("the end cat été Ж中",), (None,)], "text string")
    rows = subwords.frequency_vocabulary(df, min_count=2, max_tail=3).collect()
    pieces = {r.piece for r in rows}
    assert {"the", "cat", "##the", "##cat", "a", "ж", "##ж", "中", "[CLS]"} <= pieces
    assert not {"dog", "été", "9"} & pieces
    assert sorted(r.id for r in rows) == list(range(len(rows)))


def test_rows_without_a_batch(spark):
    df = spark.createDataFrame([(1, [1]), (1, [1, 2, 3]), (None, [5]), (None, [6, 7])], "b long, input_ids array<int>")
    rows = sorted(r.input_ids for r in sequence.pad_per_batch(df, "b").collect())
    assert rows == [[1, 0, 0], [1, 2, 3], [5, 0], [6, 7]]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    table = {i: rng.normal(size=4).astype("float32").tolist() for i in range(30)}
    rand = random.Random(2)
    docs = {d: [0] * rand.randrange(9) + [rand.randrange(33) for _ in range(rand.randrange(1, 20))]
            for d in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, token_ids array<long>")
    tf = spark.createDataFrame(list(table.items()), "token_id long, embedding array<float>")
    return df.repartition(3), tf, docs, table


@pytest.mark.parametrize("share", [10, 10_000])
def test_lookup_and_pools(vectors, share):
    df, tf, docs, table = vectors
    found = sequence.embedding_lookup(df, tf, share=share).collect()
    want = {(d, i): table[t] for d, ts in docs.items() for i, t in enumerate(ts) if t in table}
    assert {(r.doc_id, r.pos): r.embedding for r in found} == want
    for pool, fold in (
        (sequence.mean_pool, lambda m, n: m.sum(axis=0) / n),
        (sequence.max_pool, lambda m, n: m.max(axis=0)),
    ):
        got = {r.doc_id: r.pooled for r in pool(df, tf, 4, share=share).collect()}
        for d, ts in docs.items():
            known = np.array([table[t] for t in ts if t in table], dtype=float)
            if len(known):
                assert np.allclose(got.pop(d), fold(known, len(ts)))
        assert not got


def test_padding(spark):
    data = [(1, 0, [5]), (2, 0, [5, 6, 7]), (3, 1, []), (4, 1, [1, 2])]
    df = spark.createDataFrame(data, "id int, batch int, input_ids array<int>")
    got = {r.id: r.input_ids for r in sequence.pad_to_longest(df, fill=9).collect()}
    assert got == {1: [5, 9, 9], 2: [5, 6, 7], 3: [9, 9, 9], 4: [1, 2, 9]}
    for share in (1, 10_000):
        got = {r.id: r.input_ids for r in sequence.pad_per_batch(df, "batch", share=share).collect()}
        assert got == {1: [5, 0, 0], 2: [5, 6, 7], 3: [0, 0], 4: [1, 2]}
    assert df.select(pad_to("input_ids", F.lit(1)).alias("p")).first().p == [5]


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],), ([0.0, 0.0, -1.0],), ([800.0, 1.0, 0.0],)], "x array<double>")
    rows = df.select("x", argmax("x").alias("a"), softmax("x").alias("s")).collect()
    assert [r.a for r in rows] == [1, 0, 0]
    assert all(abs(sum(r.s) - 1) < 1e-12 for r in rows)
    w = [[1.0, -1.0], [0.5, 2.0], [0.0, 1.0]]
    layers = [(w, [0.0, 1.0], "relu"), ([[1.0], [2.0]], [0.5], "linear")]
    got = [r.o for r in df.select(dense("x", layers).alias("o")).collect()]
    for row, out in zip(rows, got):
        hidden = np.maximum(np.array(row.x) @ np.array(w) + [0.0, 1.0], 0)
        assert np.allclose(out, hidden @ [[1.0], [2.0]] + 0.5)


@pytest.mark.parametrize("most", [0, 30 * 4])
def test_vectors_go_to_the_tasks_up_to_a_size(vectors, monkeypatch, most):
    df, tf, docs, table = vectors
    monkeypatch.setattr(sequence, "MAX_BROADCAST_VALUES", most)
    found = sequence.embedding_lookup(df, tf, share=10)
    assert {(r.doc_id, r.pos): r.embedding for r in found.collect()} == {
        (d, i): table[t] for d, ts in docs.items() for i, t in enumerate(ts) if t in table}
    pooled = sequence.max_pool(df, tf, 4, share=10)
    for r in pooled.collect():
        assert np.allclose(r.pooled, np.max([table[t] for t in docs[r.doc_id] if t in table], axis=0))
    # In one piece, a document's rows are pooled where they are made; else they come from both sides of a lookup.
    plan = pooled._jdf.queryExecution().optimizedPlan().toString()
    assert ("Union" in plan) == (most == 0)
