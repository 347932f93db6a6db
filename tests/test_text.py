import re

import pytest
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.sql import functions as F

from starsift.functions import text as tx

TEXTS = [
    "<p>good</p> value<br/>",
    "a < b and b > c",
    "tag over <b\nline> end",
    "see https://x.io/a?b=1 now",
    "  http://x.io",
    "x https://a.b https://c.d  y",
    "no 12 digits ٤٥ left",
    "café naïve Über-cool!\nnext\tline ",
    "\U0001f600 smile",
    "",
    "   ",
    None,
]


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.o for r in df.select("i", expr("t").alias("o")).orderBy("i").collect()]


def expected(fn):
    return [None if t is None else fn(t) for t in TEXTS]


def test_cleaning_matches_python_regex(spark):
    assert column(spark, TEXTS, tx.strip_html) == expected(lambda t: re.sub(r"<.*?>", "", t))
    url = re.compile(r"\s*https?://\S+(\s+|$)")
    assert column(spark, TEXTS, tx.remove_urls) == expected(lambda t: url.sub(" ", t).strip())
    assert column(spark, TEXTS, tx.remove_digits) == expected(lambda t: re.sub(r"\d+", "", t))
    special = re.compile("[^0-9a-zA-Z ]+")
    assert column(spark, TEXTS, tx.remove_special) == expected(lambda t: special.sub("", t))


@pytest.mark.parametrize("fn", [tx.strip_html, tx.remove_digits, tx.remove_special, tx.strip_space])
def test_cleaning_is_idempotent(spark, fn):
    once = column(spark, TEXTS, fn)
    assert column(spark, once, fn) == once


def test_truncate_counts_code_points(spark):
    assert column(spark, TEXTS, lambda c: tx.truncate(c, 3)) == expected(lambda t: t[:3])


def test_headline_is_null_if_a_part_is_null(spark):
    df = spark.createDataFrame([("h", "b"), (None, "b"), ("h", None)], "h string, b string")
    got = [r[0] for r in df.select(tx.join_headline("h", "b", ".  ")).collect()]
    assert got == ["h.  b", None, None]


def test_labels(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,), ("1",)], "s string")
    got = df.select(tx.int_label("s").alias("a"), tx.int_label("s", -1).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(5, 4), (None, None), (None, None), (1, 0)]
    assert dict(df.select(tx.int_label("s", -1).alias("b")).dtypes) == {"b": "int"}


def test_tokens_match_mllib(spark):
    texts = [t for t in TEXTS if t is not None] + ["a  b\t c\n\n", " lead", "Mixed CASE_word x-y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = df.select("*", tx.whitespace_tokens("t").alias("ws"), tx.word_tokens("t").alias("re"))
    df = Tokenizer(inputCol="t", outputCol="ml_ws").transform(df)
    df = RegexTokenizer(inputCol="t", outputCol="ml_re", pattern="\\W").transform(df)
    for row in df.collect():
        assert row.ws == row.ml_ws, row.t
        assert row.re == row.ml_re, row.t


def test_stopwords_match_mllib(spark):
    words = [*tx.ENGLISH_STOPWORDS, tx.EXTRA_STOPWORD]
    assert len(words) == len(set(words)) == 180
    df = spark.createDataFrame([(["The", "xxxx", "cat", "isn't", "cat", "sat"],)], "t array<string>")
    row = (
        StopWordsRemover(inputCol="t", outputCol="ml", stopWords=words)
        .transform(df)
        .select("ml", tx.remove_stopwords("t", words).alias("ours"))
        .first()
    )
    assert row.ours == row.ml == ["cat", "cat", "sat"]


def test_basic_words(spark):
    got = column(
        spark, ["Été, it's 你好$5\u0000!", "é über"], tx.basic_words
    )
    assert got == [["ete", ",", "it", "'", "s", "你", "好", "$", "5", "!"], ["e", "uber"]]


def test_accents_of_other_scripts(spark):
    got = column(spark, ["Καλημέρα Й ё\ufffd \ue000x"], tx.basic_words)
    assert got == [["καλημερα", "и", "е", "x"]]


def test_accent_table_is_built_from_decompositions():
    source, target = tx._accent_table()
    assert len(source) == len(target) and len(source) > 200
    assert dict(zip(source, target))["é"] == "e"
    assert "ß" not in source


def test_no_python_in_cleaning_plans(spark):
    df = spark.createDataFrame([("a",)], "t string")
    chain = tx.remove_special(tx.remove_digits(tx.remove_urls(tx.strip_html(F.col("t")))))
    plan = df.select(chain)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
