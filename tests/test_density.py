import random
from collections import Counter

import pytest

from starsift.operators import density, lookup

COLS = "review_id string, product_id long, customer_id long"


@pytest.fixture(scope="module")
def rows(spark):
    """Product 0 holds a third of all rows, pair (0, 0) alone a sixth."""
    rng = random.Random(3)
    data = [(f"r{i}", 0, 0) for i in range(100)]
    data += [(f"s{i}", 0, rng.randrange(1, 40)) for i in range(100)]
    data += [(f"t{i}", rng.randrange(1, 12), rng.randrange(40)) for i in range(400)]
    data += [("n1", None, 1), ("n2", 1, None)]
    df = spark.createDataFrame(data, COLS).repartition(3)
    return df, [d for d in data if None not in d[1:]]


def brute_pairs(data, cap):
    return {k: n for k, n in Counter((p, c) for _, p, c in data).items() if n <= cap}


def brute_dense(data, cap, min_p, min_c):
    pairs = brute_pairs(data, cap)
    per_p = Counter(p for p, _ in pairs)
    per_c = Counter(c for _, c in pairs)
    return {
        (p, c, n, per_p[p], per_c[c])
        for (p, c), n in pairs.items()
        if per_p[p] >= min_p and per_c[c] >= min_c
    }


@pytest.mark.parametrize("share", [1, 7, 10_000])
def test_density_filter_with_and_without_hot_keys(rows, share):
    df, data = rows
    counts = density.stored_pair_counts(df)
    got = density.density_filter(
        counts, max_per_pair=3, min_product=20, min_customer=5, share=share
    ).select(
        "product_id", "customer_id", "n_reviews", "product_review_count", "customer_review_count"
    )
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_dense(data, 3, 20, 5) and got


@pytest.mark.parametrize("share", [7, 10_000])
def test_join_backs(rows, share):
    df, data = rows
    counts = density.stored_pair_counts(df)
    pairs = density.density_filter(counts, max_per_pair=3, min_product=20, min_customer=5)
    dense = brute_dense(data, 3, 20, 5)
    keys = {(p, c) for p, c, *_ in dense}
    copies = Counter(c for _, c in keys)
    back = density.join_back_pair(df, pairs, counts, max_per_pair=3, share=share).collect()
    assert Counter((r.review_id, r.product_id, r.customer_id) for r in back) == Counter(
        d for d in data if (d[1], d[2]) in keys
    )
    # A row with a customer but no product joins back on the customer.
    by_customer = density.join_back_customer(df, pairs, counts, share=share).collect()
    assert {(r.review_id, r.copies) for r in by_customer} == {
        (r, copies[c]) for r, p, c in [*data, ("n1", None, 1)] if c in copies
    }
    sizes = density.fan_out_sizes(pairs, counts).collect()
    detail = Counter(c for _, _, c in data)
    assert {(r.customer_id, r.joined_rows) for r in sizes} == {
        (c, copies[c] * detail[c]) for c in copies
    }


def test_pair_caps_at_the_limit(spark):
    data = [("a%02d" % i, 1, 1) for i in range(20)] + [("b%02d" % i, 1, 2) for i in range(21)]
    df = spark.createDataFrame(data, COLS)
    kept = density.pair_cap_having(density.pair_counts(df), 20).collect()
    assert [(r.customer_id, r.n_reviews) for r in kept] == [(1, 20)]
    top = {r.review_id for r in density.pair_cap_topn(df, 20).collect()}
    assert top == {d[0] for d in data} - {"b20"}


def test_topn_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, 1)], COLS)
    plan = density.pair_cap_topn(df, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("share", [5, 10_000])
def test_group_stats(rows, share):
    from pyspark.sql import functions as F

    df, data = rows
    got = lookup.with_group_stats(df, ["product_id"], share=share, top=F.max("customer_id"))
    known = [d for d in [*data, ("n2", 1, None)]]
    top = {}
    for _, p, c in known:
        top[p] = max(top.get(p, -1), -1 if c is None else c)
    assert {(r.review_id, r.top) for r in got.collect()} == {(r, top[p]) for r, p, _ in known}


def test_hot_keys_are_bounded(spark):
    counts = spark.createDataFrame([(i, 100 - i) for i in range(100)], "k int, n long")
    for share in (1, 10, 50):
        assert lookup.hot_keys(counts, ["k"], "n", share).count() <= share


def test_counts_of_all_and_of_some_rows_in_one_pass(rows):
    from pyspark.sql import functions as F

    df, data = rows
    every, some = density.stored_pair_counts_within(df, F.col("review_id").startswith("t"))
    as_dict = lambda c: {(r.product_id, r.customer_id): r.n_reviews for r in c.collect()}
    assert as_dict(every) == Counter((p, c) for _, p, c in data)
    assert as_dict(some) == Counter((p, c) for r, p, c in data if r.startswith("t"))


def test_join_back_customer_shuffles_no_rows_if_all_customers_fit(rows):
    """By default the commonest customers meet their rows by broadcast, not only the hot ones."""
    df, data = rows
    counts = density.stored_pair_counts(df)
    pairs = density.density_filter(counts, max_per_pair=3, min_product=20, min_customer=5)
    back = density.join_back_customer(df, pairs, counts)
    assert "Union" not in back._jdf.queryExecution().executedPlan().toString()
    copies = Counter(c for _, c, *_ in brute_dense(data, 3, 20, 5))
    assert {(r.review_id, r.copies) for r in back.collect()} == {
        (r, copies[c]) for r, p, c in [*data, ("n1", None, 1)] if c in copies
    }
