import pytest
from pyspark.sql import functions as F

from starsift.operators import profile, setops
from starsift.schema import REVIEW_COLUMNS, REVIEW_TEXT
from starsift.session import scratch_path, stored
from starsift.sources import files

HEADER = "\t".join(REVIEW_COLUMNS)


@pytest.fixture
def tsv(tmp_path):
    lines = [
        HEADER,
        'c1\tr1\tp1\t"a\tquoted"\tbody\t5',
        "c2\tr2\tp2\thead\tbody",
        "c3\tr3\tp3\thead\tbody\t4\textra",
        "c4\tr4\tp4\thead\tbody\t4\t",
        "c5\tr5\tp5\tNA\t\tx",
        "c6\tr6\tp6\thead\tbody\t4\tmore\tand more",
    ]
    path = tmp_path / "reviews.tsv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_plain_scan_pads_and_cuts(spark, tsv):
    rows = {r.review_id: r for r in files.read_reviews(spark, tsv).collect()}
    assert len(rows) == 6
    assert rows["r1"].review_headline == "a\tquoted" and rows["r1"].star_rating == "5"
    assert rows["r2"].star_rating is None and rows["r5"].review_headline == "NA"
    typed = {r.review_id: r for r in files.read_reviews(spark, tsv, typed=True).collect()}
    assert typed["r1"].star_rating == 5 and typed["r5"].star_rating is None


def test_scan_that_skips_long_lines(spark, tsv):
    df = files.read_reviews_skip_long(spark, tsv)
    rows = {r.review_id: r for r in df.collect()}
    assert set(rows) == {"r1", "r2", "r5"}
    assert rows["r2"].star_rating is None
    assert rows["r5"].review_headline is None and rows["r5"].review_body is None
    assert df.schema.names == REVIEW_TEXT.names
    # The count must not change when columns are pruned.
    assert df.select("review_id").count() == df.count() == 3


def test_csv_round_trip(spark):
    data = [('say "hi", ok', 1), ("line\nbreak \\ back", 2), (" edge ", 3), ("plain", None)]
    df = spark.createDataFrame(data, "text string, label int")
    path = scratch_path(spark, "t")
    files.write_csv(df, path, max_rows_per_file=1)
    back = files.read_text_label(spark, path, multi_line=True)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(data, key=repr)


def test_one_file_and_splits(spark, tmp_path):
    df = spark.range(10).selectExpr("cast(id as string) text", "cast(id as int) label").repartition(4)
    path = str(tmp_path / "one")
    files.write_csv(df, path, one_file=True)
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1
    tagged = df.selectExpr("*", "if(label < 3, 'test', 'train') split")
    paths = {n: str(tmp_path / n) for n in ("train", "test")}
    files.write_splits(tagged, paths)
    back = files.read_splits(spark, paths)
    assert {r.split: r["count"] for r in back.groupBy("split").count().collect()} == {
        "train": 7, "test": 3,
    }


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_feature_sink(spark, fmt):
    from pyspark.ml.feature import HashingTF

    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "id int, words array<string>")
    tf = HashingTF(inputCol="words", outputCol="f", numFeatures=16).transform(df).select("id", "f")
    path = scratch_path(spark, "f")
    files.write_features(tf, path, fmt=fmt)
    want = {r.id: r.f.toArray().tolist() for r in tf.collect()}
    if fmt == "parquet":
        got = spark.read.parquet(path)
    else:
        got = spark.read.csv(path, header=True, schema="id int, f string", escape='"')
        got = got.selectExpr("id", "from_json(f, 'array<double>') f")
    assert {r.id: r.f for r in got.collect()} == want


def test_null_profile_and_filters(spark):
    df = spark.createDataFrame(
        [("a", 1.0), (None, float("nan")), ("", None), ("abc", 2.0)], "s string, x double"
    )
    assert tuple(profile.null_profile(df).first()) == (1, 2)
    assert profile.drop_nulls(df).count() == 2
    assert profile.drop_nulls(df, ["s"]).count() == 3
    assert profile.min_length(df, "s", 3).count() == 1


def test_scratch_uses_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(base)
    df = stored(spark.range(5), "x")
    assert df.count() == 5 and base in df.inputFiles()[0]


def test_union_all_matches_names(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, i int")
    assert sorted(map(tuple, setops.union_all([a, b, a]).collect())) == [(1, "x"), (1, "x"), (2, "y")]


def test_tables_are_dealt_anew_only_on_demand(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    assert files.read_table(spark, path, 3).rdd.getNumPartitions() == 3
    plan = files.read_table(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


WIDE = [
    "marketplace\tcustomer_id\treview_id\tproduct_id\tstar_rating\treview_headline\treview_body",
    "US\tC1\tR1\tP1\t5\tHead\tBody",
    "US\tC2\tR2\tP2\t4\tHead\tBody\tsurplus",
]


def test_columns_follow_the_header(spark, tmp_path):
    path = tmp_path / "wide.tsv"
    path.write_text("\n".join(WIDE) + "\n")
    want = dict(customer_id="C1", review_id="R1", product_id="P1", review_headline="Head",
                review_body="Body", star_rating="5")
    rows = {r.review_id: r for r in files.read_reviews(spark, str(path)).collect()}
    assert rows["R1"].asDict() == want and set(rows) == {"R1", "R2"}
    assert files.read_reviews(spark, str(path), typed=True).first().star_rating == 5
    assert [r.asDict() for r in files.read_reviews_skip_long(spark, str(path)).collect()] == [want]
    narrow = tmp_path / "narrow.tsv"
    narrow.write_text("customer_id\treview_id\nC1\tR1\n")
    for read in (files.read_reviews, files.read_reviews_skip_long):
        with pytest.raises(ValueError, match="star_rating"):
            read(spark, str(narrow))


def test_quotes_and_tabs_come_back(spark):
    row = ("c", "r", "p", 'say "hi"\tx', '"a \\ "b" c\td\ne', "5")
    df = spark.createDataFrame([row], REVIEW_TEXT)
    path = scratch_path(spark, "q")
    files.write_csv(df, path, sep="\t")
    assert tuple(files.read_reviews(spark, path, multi_line=True).first()) == row


def test_rejects_and_rows_are_all_lines(spark, tsv):
    rejects = files.read_rejects(spark, tsv)
    rows = {r.line.split("\t")[1]: r for r in rejects.collect()}
    assert {i: r.n_fields for i, r in rows.items()} == {"r3": 7, "r4": 7, "r6": 8}
    assert all(r.file.endswith("reviews.tsv") and r.reason.endswith("6 expected") for r in rows.values())
    assert rejects.count() + files.read_reviews_skip_long(spark, tsv).count() == 6
    # Without a header line all lines are rows, the first one too.
    assert files.read_rejects(spark, tsv, header=False).count() == 3


def test_rejects_of_an_empty_file(spark, tmp_path):
    path = tmp_path / "empty.tsv"
    path.write_text("")
    assert files.read_rejects(spark, str(path)).count() == 0


def test_profile_counted_while_writing(spark):
    df = spark.createDataFrame(
        [(1, None, float("nan")), (2, "a", 1.0), (None, None, None)], "n_rows long, missing string, x double"
    )
    done = profile.write_profiled(df, scratch_path(spark, "profiled"))
    assert done.n_rows == 3 and done.missing == {"n_rows": 1, "missing": 2, "x": 2} and done.seconds > 0
    assert done.profile().collect() == profile.null_profile(df).collect()
    assert done.rows.count() == 3 and done.rows.schema == df.schema
    empty = profile.write_profiled(df.limit(0), scratch_path(spark, "profiled"))
    assert empty.n_rows == 0 and set(empty.missing.values()) == {0} and empty.rows.count() == 0


def test_a_scan_with_tasks_enough_is_not_dealt_into_fewer(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = spark.range(60).select(*[F.col("id").cast("string").alias(c) for c in REVIEW_COLUMNS]).repartition(6)
    files.write_csv(rows, path, sep="\t")
    with_parts = lambda n: files.read_reviews(spark, path, typed=True, partitions=n)
    whole = with_parts(None).rdd.getNumPartitions()
    assert whole > 2 and with_parts(2).rdd.getNumPartitions() == whole
    assert with_parts(whole + 3).rdd.getNumPartitions() == whole + 3
    assert with_parts(2).count() == 60
