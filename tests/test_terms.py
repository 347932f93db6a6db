import random
from collections import Counter
from math import log

import pytest
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer
from pyspark.sql import functions as F

from starsift.operators import lookup, terms


@pytest.fixture(scope="module")
def docs(spark):
    """'the' is everywhere, w* have a falling frequency, some documents are odd."""
    rng = random.Random(5)
    data = []
    for i in range(120):
        words = ["the"] * rng.randrange(1, 4)
        words += [f"w{min(int(rng.expovariate(0.2)), 60)}" for _ in range(rng.randrange(0, 12))]
        rng.shuffle(words)
        data.append((i, words))
    data += [(200, []), (201, ["only"]), (202, ["", "the", ""])]
    return spark.createDataFrame(data, "review_id long, tokens array<string>").repartition(4), data


def frequencies(data):
    return Counter(t for _, tokens in data for t in set(tokens))


def test_counts(docs):
    df, data = docs
    got = terms.document_frequency(df).collect()
    assert {r.term: r.df for r in got} == dict(frequencies(data))
    tf = terms.term_frequency(df).collect()
    want = {(i, t): n for i, tokens in data for t, n in Counter(tokens).items()}
    assert {(r.review_id, r.term): r.tf for r in tf} == want and len(tf) == len(want)


def test_term_frequency_needs_no_shuffle(docs):
    df, _ = docs
    scan = df.sparkSession.createDataFrame([(1, ["a"])], df.schema)
    plan = terms.term_frequency(scan)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("share", [20, 10_000])
@pytest.mark.parametrize("floor", [0, 20])
def test_tfidf_matches_mllib(docs, share, floor):
    df, data = docs
    got = {
        (r.review_id, r.term): r.tfidf
        for r in terms.tfidf(df, min_doc_freq=floor, share=share).collect()
    }
    cv = CountVectorizer(inputCol="tokens", outputCol="raw").fit(df)
    weighted = IDF(inputCol="raw", outputCol="w", minDocFreq=floor).fit(cv.transform(df))
    want = {}
    for row in weighted.transform(cv.transform(df)).collect():
        v = row.raw
        for i in v.indices:
            want[(row.review_id, cv.vocabulary[i])] = float(row.w[int(i)])
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_idf_at_the_threshold(spark):
    df = spark.createDataFrame([("a", 19), ("b", 20), ("c", 21)], "term string, df long")
    got = {r.term: r.idf for r in terms.idf_weights(df, F.lit(99), 20).collect()}
    assert got["a"] == 0 and abs(got["b"] - log(100 / 21)) < 1e-12 and got["c"] > 0


@pytest.mark.parametrize("share", [20, 10_000])
@pytest.mark.parametrize("min_df", [3, 21, 500])
def test_vocabulary_filters(docs, share, min_df):
    df, data = docs
    freq = frequencies(data)
    kept = {r.review_id for r in terms.vocab_filter_rows(df, min_df=min_df, share=share).collect()}
    assert kept == {i for i, tokens in data if all(freq[t] >= min_df for t in tokens)}
    got = terms.vocab_filter_tokens(df, min_df=min_df, share=share).collect()
    assert {r.review_id: r.tokens for r in got} == {
        i: [t for t in tokens if freq[t] >= min_df] for i, tokens in data
    }


def test_twenty_other_reviews(spark):
    """df 21 means 20 other reviews and stays; df 20 goes."""
    data = [(i, ["a"]) for i in range(21)] + [(100 + i, ["b"]) for i in range(20)]
    df = spark.createDataFrame(data, "review_id long, tokens array<string>")
    kept = {r.review_id for r in terms.vocab_filter_rows(df).collect()}
    assert kept == set(range(21))


def test_label_index_matches_mllib(spark):
    df = spark.createDataFrame([(x,) for x in "bbaaccd"] + [(None,)], "label string")
    got = {r.label: r.idx for r in terms.label_index(df).collect()}
    model = StringIndexer(inputCol="label", outputCol="i", handleInvalid="skip").fit(df)
    assert got == {label: float(i) for i, label in enumerate(model.labels)}
    assert got == {"a": 0.0, "b": 1.0, "c": 2.0, "d": 3.0}


def test_attach_features(docs):
    df, data = docs
    out = terms.attach_features(df.select("review_id"), terms.term_frequency(df))
    assert out.count() == sum(len(set(t)) for _, t in data)


def test_common_terms_are_not_shuffled(docs):
    """Texts are read once for their terms, and a vocabulary that fits goes to the tasks whole."""
    df, _ = docs
    plan = terms.tfidf(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning(term" not in plan


@pytest.mark.parametrize("most", [0, 1, 7, 1000])
def test_tfidf_of_common_and_rare_terms(docs, most):
    df, data = docs
    got = terms.tfidf(df, most=most).select("review_id", "term", "tf", "df").collect()
    freq = frequencies(data)
    want = {(i, t, n, freq[t]) for i, tokens in data for t, n in Counter(tokens).items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_common_keys(spark):
    counts = spark.createDataFrame([(i, 1000 // (i + 1)) for i in range(200)], "k long, n long")
    keys, every = lookup.common_keys(counts, ["k"], "n", 50)
    got = {r.k for r in keys.collect()}
    assert not every and 30 <= len(got) <= 50 and got == set(range(len(got)))
    assert lookup.common_keys(counts, ["k"], "n", 200)[1]
