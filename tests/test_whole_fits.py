"""The model queries fit on every train row of a known class, however large the class."""

import pytest
from pyspark.sql import functions as F

from starsift.catalog import QUERIES, modelling
from starsift.operators import models, wordvectors


class Fitted(Exception):
    pass


@pytest.fixture(scope="module")
def documents_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("documents"))
    lang = F.when(F.col("id") < 7000, "en").when(F.col("id") < 7300, "fr")
    spark.range(7400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a text of "), F.col("id") % 9).alias("text"), lang.alias("lang"),
        F.lit("made").alias("source"), F.lit(11).cast("long").alias("n_chars"),
    ).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["cv_mlp", "cv_rf", "flow_word2vec_forest", "mlp_predict", "word2vec_doc"])
def test_fits_see_all_train_rows(spark, documents_dir, monkeypatch, name):
    def fitted(df):
        raise Fitted({r.label: r["count"] for r in df.groupBy("label").count().collect()})

    for kind in ("cross_validate", "fit_classifier"):
        monkeypatch.setattr(models, kind, lambda df, *a, **b: fitted(df))
    monkeypatch.setattr(wordvectors.SkipGram, "_fit", lambda self, df: fitted(df))
    train = modelling.labelled_docs(spark, documents_dir).filter("split = 'train' and label is not null").collect()
    want = {c: sum(r.label == c for r in train) for c in ("en", "fr")}
    assert want["en"] > 5500 and want["fr"] > 100
    with pytest.raises(Fitted) as found:
        QUERIES[name](spark, documents_dir)
    assert found.value.args == (want,)


def test_word_vector_rows_are_all_cleaned_reviews(spark, tmp_path):
    ids = spark.range(300)
    ids.select(
        F.col("id").alias("doc_id"), F.lit("word text").alias("text"), F.lit("en").alias("lang"),
        F.lit("made").alias("source"), (F.col("id") % 2).alias("n_chars"),
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).select(
        F.col("id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.lit("").alias("html")
    ).write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["flow_word_vector_rows"](spark, str(tmp_path)).collect()
    # doc_id % 29 = 0 has no headline and is no cleaned review.
    assert sorted(r.review_id for r in rows) == [i for i in range(300) if i % 29]
    assert sum(r.split == "test" for r in rows) == -(-len(rows) // 5) and {r.label for r in rows} == {0, 1}
