import hashlib
from collections import defaultdict
from math import ceil

import pytest
from pyspark.sql import functions as F

from starsift.operators import sampling, setops


def h(key, seed=None):
    text = str(key) if seed is None else f"{key}|{seed}"
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def rows(spark):
    """Class 1 holds most rows, class 3 is smaller than any cap, some labels are null."""
    data = [(i, 1 if i % 3 else 2) for i in range(3000)]
    data += [(i, 3) for i in range(3000, 3007)] + [(5000, None)]
    return spark.createDataFrame(data, "review_id long, label int").repartition(5), data


def brute_caps(data, n, seed):
    groups = defaultdict(list)
    for key, label in data:
        if label is not None:
            groups[label].append((h(key, seed), key))
    return {(k, lab) for lab, ks in groups.items() for _, k in sorted(ks)[:n]}


@pytest.mark.parametrize("n", [5, 1200])
@pytest.mark.parametrize("share", [3, 10_000])
def test_class_caps(rows, n, share):
    df, data = rows
    got = sampling.take_first(df, n, key="review_id", by=["label"], seed=9, share=share)
    assert sorted(map(tuple, got.collect())) == sorted(brute_caps(data, n, 9))


def test_sliced_caps_match_for_small_limits(rows, monkeypatch):
    df, data = rows
    for bits in (2, 16):
        monkeypatch.setattr(sampling, "CUT_BITS", bits)
        for share in (2, 10_000):
            got = sampling.take_first(df, 37, key="review_id", by=["label"], share=share)
            assert sorted(map(tuple, got.collect())) == sorted(brute_caps(data, 37, None))


@pytest.mark.parametrize("n", [0, 3, 999, 1000, 1001, 1200, 5000])
def test_limits_with_null_keys(spark, n):
    """1000 keys and 500 rows without: the latter fill up what the keys leave."""
    data = [(i, i) for i in range(1000)] + [(None, i) for i in range(500)]
    df = spark.createDataFrame(data, "k long, v long").repartition(5)
    got = [r.k for r in sampling.take_first(df, n, key="k", seed=3).collect()]
    keys = {k for k in got if k is not None}
    assert len(got) == min(n, 1500) and len(keys) == min(n, 1000)
    assert keys == {k for _, k in sorted((h(k, 3), k) for k in range(1000))[:n]}
    flagged = sampling.flag_first(df, n, key="k", seed=3).collect()
    assert sorted(str(r.k) for r in flagged if r.chosen) == sorted(map(str, got))


def test_exact_split_with_null_keys(spark):
    data = [(i if i % 3 else None, i) for i in range(3000)]
    df = spark.createDataFrame(data, "review_id long, v long")
    for share, with_key in ((0.2, 600), (0.9, 2000)):
        rows = sampling.split_exact(df, share).filter("split = 'test'").collect()
        assert len(rows) == 3000 * share
        assert sum(r.review_id is not None for r in rows) == with_key


@pytest.mark.parametrize("n", [0, 10, 1500, 9999])
def test_global_limit_and_flag(rows, n):
    df, data = rows
    want = {k for _, k in sorted((h(k, 4), k) for k, _ in data)[:n]}
    flagged = sampling.flag_first(df, n, key="review_id", seed=4).collect()
    assert len(flagged) == len(data)
    assert {r.review_id for r in flagged if r.chosen} == want
    got = sampling.take_first(df, n, key="review_id", seed=4).collect()
    assert {r.review_id for r in got} == want and len(got) == len(want)


def test_balance_lists_classes(rows):
    df, data = rows
    got = sampling.balance_classes(df, 50, classes=[2, 3]).collect()
    assert {(r.review_id, r.label) for r in got} == {
        x for x in brute_caps(data, 50, None) if x[1] in (2, 3)
    }


@pytest.mark.parametrize("share", [0.2, 1.0])
def test_exact_split(rows, share):
    df, data = rows
    got = sampling.split_exact(df, share, seed=1).collect()
    assert len(got) == len(data)
    assert sum(r.split == "test" for r in got) == ceil(share * len(data))


def test_splits_and_folds_do_not_depend_on_partitioning(rows):
    df, data = rows

    def run(frame):
        out = sampling.with_fold(sampling.split_share(frame, 90, seed=1234), 5)
        return sorted((r.review_id, r.split, r.fold) for r in out.collect())

    first = run(df)
    assert first == run(df.repartition(2)) == run(df.orderBy(F.desc("review_id")))
    assert [k for k, *_ in first] == sorted(k for k, _ in data)
    assert {f for *_, f in first} == {0, 1, 2, 3, 4}
    assert 0.87 < sum(s == "train" for _, s, _ in first) / len(first) < 0.93


def test_fold_frames_and_sizes(rows):
    df, data = rows
    folded = sampling.with_fold(df, 5)
    sizes = {r.fold: r for r in sampling.fold_sizes(folded).collect()}
    for k in range(5):
        train, held_out = sampling.fold_frames(folded, k)
        assert train.count() == sizes[k].train_rows
        assert held_out.count() == sizes[k].eval_rows
        assert sizes[k].train_rows + sizes[k].eval_rows == len(data)
    assert sum(s.eval_rows for s in sizes.values()) == len(data)


def test_union_and_complement(rows):
    df, data = rows
    part = sampling.take_first(df, 100, key="review_id")
    rest = setops.complement(df, part)
    both = setops.union_named({"a": part, "b": rest})
    assert both.count() == len(data) and both.select("review_id").distinct().count() == len(data)
    assert {r.split: r["count"] for r in both.groupBy("split").count().collect()} == {
        "a": 100, "b": len(data) - 100,
    }


def test_except_rows_matches_subtract(spark):
    from pyspark.ml.linalg import Vectors

    left = [(1, "a", ["x"], Vectors.dense(1.0))] * 3 + [(2, None, ["y"], Vectors.dense(2.0))] * 2
    left += [(None, "b", [], Vectors.sparse(2, [0], [1.0])), (4, "d", None, None)]
    right = [(2, None, ["y"], Vectors.dense(2.0)), (9, "z", [], Vectors.dense(0.0))]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("i", T.IntegerType()), T.StructField("s", T.StringType()),
            T.StructField("a", T.ArrayType(T.StringType())), T.StructField("v", VectorUDT()),
        ]
    )
    lf, rf = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = sorted(map(str, setops.except_rows(lf, rf).collect()))
    assert got == sorted(map(str, lf.subtract(rf).collect())) and len(got) == 3


def test_except_rows_query_collapses_repeats_before_the_words(spark, monkeypatch):
    """The wide rows with their word lists are made of distinct rows only."""
    from starsift.catalog import relational

    data = [(f"r{i}", i % 3, f"Big  text {i % 7}") for i in range(60)] + [("x", None, None), ("y", 1, None)]
    df = spark.createDataFrame(data, "review_id string, label int, review_body string")
    monkeypatch.setattr(relational, "labelled", lambda *_: df)
    got = relational.except_rows(spark, "")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [review_body") >= 2 and plan.count("Aggregate") >= 3
    part = {(b, n) for _, n, b in df.filter(sampling.bucket("review_id", 2) == 0).select("review_id", "label", "review_body").collect()}
    want = {(b, n) for _, n, b in data} - part
    rows = got.collect()
    assert {(r.review_body, r.label) for r in rows} == want and len(rows) == len(want)
