"""Hard negatives by the tree against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starsift.llm import gnat

SCHEMA = "vec_id long, embedding array<float>, label int, score int, leaf string, uid int"


def plain(rows, every, positives=5, negatives=5):
    fit = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, label, v) in enumerate(fit):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other == label) for k, (j, other, w) in enumerate(fit) if k != at]
        for ps, pid, _ in sorted(x for x in scored if x[2])[:positives]:
            window = sorted(x for x in scored if not x[2] and 80 * -ps <= 100 * -x[0] <= 100 * -ps)
            out += [(i, pid, rank, j, -ps, -s) for rank, (s, j, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in gnat.hard_negatives(df.repartition(3), F.col("id") % every == 0, **how).collect())


def clustered(count, width, seed):
    draw = np.random.default_rng(seed)
    centres = 4 * draw.normal(size=(6, width))
    x = centres[draw.integers(0, 6, count)] + 0.3 * draw.normal(size=(count, width))
    return [(i, v.tolist(), int(draw.integers(0, 3))) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_products(spark, monkeypatch, seed):
    monkeypatch.setattr(gnat, "ROW_BLOCK", 20)
    monkeypatch.setattr(gnat, "ANCHOR_BLOCK", 7)
    rows = clustered(400, 5, seed)
    shape = {"sample_rows": 200, "degree": 3, "leaf_rows": 12, "levels": 4}
    got = mined(spark, rows, 10, **shape)
    assert got == plain(rows, 10) and len(got) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (20, [1.0, 0.5], 2), (21, [0.9, 0.5], 2), (22, [], 2), (23, [0.0, 0.0], 1),
            (24, [nan, 1.0], 1), (25, [inf, 1.0], 2), (26, None, 1), (27, [1.0, None], 1), (28, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
            (30, [-3.0, 1.0], 1), (31, [1e4, 2e4], 3), (33, [2.0], 3)]
    assert mined(spark, rows, 10) == plain(rows, 10)
    big = [(0, [3e4, 2e4], 1), (1, [3e4, 1e4], 1), (2, [2.5e4, 1e4], 2), (3, [1e30, 1.0], 2)]
    assert mined(spark, big, 10) == plain(big[:3], 10) != []
    assert gnat.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).collect() == []


def test_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(gnat, "ROW_BLOCK", 50)
    rows = [(i, [0.25, 0.5], i % 2) for i in range(300)]
    shape = {"degree": 3, "leaf_rows": 12}
    assert mined(spark, rows, 100, **shape) == plain(rows, 100)


def test_ranges_eliminate_subtrees():
    rows = clustered(3000, 5, 3)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    tree = gnat.Tree.grow(x[:1000], leaf_rows=40)
    for place, under, apart, near in tree.walk(x):
        node = tree.nodes[place]
        for j in np.unique(near):
            mine = near == j
            node.low[:, j], node.high[:, j] = apart[mine].min(axis=0), apart[mine].max(axis=0)
            square = (x[under[mine]] ** 2).sum(axis=1)
            node.least[j], node.most[j] = square.min(), square.max()
    q, products = x[::100], x[::100] @ x.T
    high = np.sort(products, axis=1)[:, -5][:, None]
    low, leaf, visits = 0.98 * high, tree.leaf_of(x), 0
    met = {(at, int(r)) for at, anchors in tree.left(q, low, high) for r in anchors}
    for a, s in enumerate(products):
        assert {(int(at), a) for at in leaf[(s >= low[a]) & (s <= high[a])]} <= met
    assert len(met) < 0.5 * tree.leaves * len(q)


def test_table(spark, sf_dir, result):
    got = result("op12_gnat_negatives")
    rows = [
        (r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
        for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ]
    assert sorted(got.itertuples(index=False, name=None)) == plain(rows, 100)
