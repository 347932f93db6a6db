"""The fit against a plain version, and labels that it has not seen."""

import math
import os
import tracemalloc

import numpy as np
import pytest

from starsift.llm import toxicity

LARGER = "/root/testdata/sf0.1"


def plain_ftrl(rows, labels, l1):
    z, n = {}, {}

    def weight(i):
        if i not in z or (i != "base" and abs(z[i]) <= l1):
            return 0.0
        shrunk = z[i] - (math.copysign(l1, z[i]) if i != "base" else 0.0)
        return -shrunk / ((toxicity.SMOOTH + math.sqrt(n[i])) / toxicity.RATE + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for row, label in zip(rows, labels):
            held = {i: weight(i) for i in [*row, "base"]}
            p = 1 / (1 + math.exp(-sum(held.values())))
            g = (p - label) * (toxicity.POSITIVE if label else 1.0)
            for i, w in held.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / toxicity.RATE * w
    return {i: weight(i) for i in z}


def test_ftrl_equals_the_plain_version():
    draw = np.random.default_rng(8)
    rows = [np.unique(draw.integers(0, 40, draw.integers(0, 9))) for _ in range(120)]
    labels = np.array([float(3 in r or draw.random() < 0.1) for r in rows])
    for l1 in (0.0, 0.7, 4.0):
        weights, base = toxicity.ftrl(rows, labels, l1)
        want = plain_ftrl([r.tolist() for r in rows], labels.tolist(), l1)
        assert abs(base - want.pop("base")) < 1e-9
        assert all(abs(weights[i] - w) < 1e-9 for i, w in want.items())
        assert np.count_nonzero(weights) == sum(w != 0 for w in want.values())


def test_held_out_labels(spark):
    if not os.path.isdir(LARGER):
        pytest.skip("no benchmark tables")
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    held = toxicity.held_out("doc_id")
    model = toxicity.fit(docs, labels.where(~held))
    known = labels.where(held & labels.toxic.isNotNull()).groupBy("doc_id").agg({"toxic": "max"})
    rows = toxicity.score(docs.join(known, "doc_id"), model).toPandas()
    said, true = rows.score >= 0.5, rows["max(toxic)"] > 0
    assert (said & true).sum() / true.sum() >= 0.8
    assert (said & true).sum() / said.sum() >= 0.9


def test_clashing_column(spark, odd):
    labels = spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int")
    with pytest.raises(ValueError):
        toxicity.score(odd, toxicity.fit(odd, labels))


def test_choosing_features_takes_less_memory_than_the_rows(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << toxicity.BITS, 900)).astype(np.int32) for _ in range(20_000)]
    got = []
    monkeypatch.setattr(toxicity, "ftrl", lambda rows, labels, l1: got.append(rows))
    tracemalloc.start()
    toxicity.ftrl_chosen(rows, np.zeros(len(rows)), np.zeros(len(rows), dtype=bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = np.bincount(np.concatenate(rows), minlength=1 << toxicity.BITS)
    assert all(np.array_equal(a, r[n[r] >= toxicity.LEAST_ROWS]) for a, r in zip(got[0], rows))
    assert peak < 2 * sum(r.nbytes for r in rows)
