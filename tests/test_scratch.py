"""Steps free the files that nothing reads again."""

import os
import re

import pytest
from pyspark.sql import functions as F

from starsift.catalog import QUERIES
from starsift.plans import flows
from starsift.session import scratch_freed, shared_path, stored

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture
def folders(spark):
    top = os.path.dirname(shared_path(spark, "x"))
    seen = set(os.listdir(top))
    return lambda: {re.fullmatch(r"starsift-(.+)-[0-9a-f]{32}", f)[1] for f in set(os.listdir(top)) - seen}


def test_notebook_flow_leaves_what_it_reads(spark, folders):
    reviews = spark.range(120).select(
        F.col("id").cast("string").alias("review_id"), (F.col("id") % 4).alias("product_id"), (F.col("id") % 3).alias("customer_id"),
        F.lit("head").alias("review_headline"), F.concat(F.lit("a text that is long enough "), F.col("id") % 5).alias("review_body"),
        F.lit(3).alias("star_rating"),
    )
    before = spark.conf.get(FREED)
    rows = flows.notebook_features(reviews, min_doc_freq=2)
    assert folders() <= {"cleaned", "term-ids", "numbered"}
    assert rows.count() == 120 and spark.conf.get(FREED) == before


def test_notebook_query_leaves_its_features(spark, tmp_path, folders):
    lines = spark.range(4000).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 60).alias("l_partkey"),
        F.lit(1).cast("long").alias("l_suppkey"), F.lit(1.5).alias("l_extendedprice"), (F.col("id") % 9 + 1).cast("double").alias("l_quantity"),
    )
    orders = spark.range(4000).select(F.col("id").alias("o_orderkey"), (F.col("id") / 60).cast("long").alias("o_custkey"))
    parts = spark.range(60).select(
        F.col("id").alias("p_partkey"), F.lit("red green blue").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        F.concat(F.lit("LARGE TIN "), F.col("id")).alias("p_type"),
    )
    for name, df in (("lineitem", lines), ("orders", orders), ("part", parts)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = QUERIES["flow_notebook"](spark, str(tmp_path))
    assert folders() == {"features"} and found.count() > 100


def test_files_stored_inside_go(spark, folders):
    with scratch_freed(spark) as kept:
        with scratch_freed(spark) as inner:
            stored(spark.range(3), "gone")
            middle = inner(spark.range(3), "middle")
        assert folders() == {"middle"}
        last = kept(middle.select("id"), "last")
    assert folders() == {"last"} and last.count() == 3
    with pytest.raises(KeyError), scratch_freed(spark):
        stored(spark.range(3), "stopped")
        raise KeyError
    assert folders() == {"last"} and stored(spark.range(2), "later").count() == 2
