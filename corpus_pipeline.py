"""Corpus pipeline: toxicity, quality rules, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of ``documents``. For the rest of the session tasks and
their Python workers exchange at most ``BATCH_BYTES`` at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starsift.llm import forest, packing, quality, secrets, toxicity
from starsift.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Spark's own limit is 64 MB, which each worker holds several times over: as Arrow, as strings and as results.
BATCH_BYTES = "4m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """The stage with batches of ``BATCH_BYTES``; its result runs later, so the setting stays."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return bounded


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


@_bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half; null and empty texts are scored as texts without words."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(docs.select(*COLUMNS), model, out="_toxic").where("_toxic < 0.5").select(*COLUMNS)


@_bounded
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learnt ones reject; null and empty texts fail the base rules."""
    rules = quality.fit(docs, _labels(spark, sf_dir))
    return quality.judge(docs.select(*COLUMNS), rules).where("kept").select(*COLUMNS)


@_bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity of 0.8 or more); repeated rows once.

    Texts decide, not ids: ids may repeat or be null. Documents without words stay.
    """
    return forest.one_of_each(docs.select(*COLUMNS))


@_bounded
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by a mark; null texts stay null."""
    clean = secrets.redact(docs.select(*COLUMNS), secrets.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_bounded
def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their bins; null and empty texts have no words, see ``packing.pack``."""
    sized = docs.select("doc_id", "source", packing.word_count().alias("n_words"), packing.text_cluster().alias("cluster"))
    return packing.pack(sized, size="n_words", cluster="cluster")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

#: Learnt decisions cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
