"""What the stages of the pipeline hold at a time."""

import corpus_pipeline
import pandas as pd
from pyspark.sql import functions as F


def test_long_texts_go_to_workers_in_small_batches(spark, monkeypatch, tmp_path):
    """Twelve texts of 1 MB in one partition, at most 4 MB of them in a batch, and all of them scored."""
    from starsift.llm import toxicity

    @F.pandas_udf("double")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([float(len(texts))] * len(texts))

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(toxicity, "score", lambda docs, model, out: docs.withColumn("text", rows("text").cast("string")).withColumn(out, F.lit(0.0)))
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.range(0, 12, 1, 1).selectExpr("id doc_id", "repeat('word ', 200000) text", "'en' lang", "'s' source", "1000000L n_chars")
    try:
        sizes = [float(r.text) for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()]
    finally:
        spark.conf.set(setting, before)
    assert len(sizes) == 12 and max(sizes) <= 5
