"""Scans and sinks: every query writes files from the tables and reads them back."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from starsift.catalog.cleaning import SCRIPT_SQL, clean_script
from starsift.catalog.fixtures import view
from starsift.catalog.registry import query
from starsift.catalog.relational import sql_hash
from starsift.catalog.texts import tokenized
from starsift.functions.hashing import bucket
from starsift.operators import sampling
from starsift.schema import REVIEW_COLUMNS
from starsift.session import scratch_path
from starsift.sources import files

CAST_SQL = ", ".join(f"cast({c} as varchar) as {c}" for c in REVIEW_COLUMNS)
SPLIT_SQL = f"""script as ({SCRIPT_SQL}),
    parts as (select *, case when {sql_hash('review_id', 1234)} % 100 < 80 then 'train'
              else 'test' end as split from script)"""


def _review_file(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    files.write_csv(view(spark, sf_dir, "reviews").select(*REVIEW_COLUMNS), path, sep="\t")
    return path


def _split_files(spark, sf_dir):
    rows = sampling.split_share(clean_script(spark, sf_dir), 80, seed=1234)
    base = scratch_path(spark, "splits")
    paths = {name: f"{base}/{name}" for name in ("train", "test")}
    files.write_splits(rows.select("text", "label", "split"), paths)
    return paths


@query("scan_tsv", f"select {CAST_SQL} from reviews", ("reviews",))
def scan_tsv(spark, sf_dir):
    return files.read_reviews(spark, _review_file(spark, sf_dir))


@query(
    "scan_tsv_typed",
    "select review_id, review_body, star_rating as label from reviews",
    ("reviews",),
)
def scan_tsv_typed(spark, sf_dir):
    df = files.read_reviews(spark, _review_file(spark, sf_dir), typed=True, partitions=7)
    return df.select("review_id", "review_body", F.col("star_rating").alias("label"))


def _uneven_lines(spark, sf_dir):
    """A file without header; a tenth of the lines gets a surplus field, another tenth loses its last one."""
    df = view(spark, sf_dir, "reviews")
    kind = bucket("review_id", 10)
    fields = [F.col(c).cast("string") for c in REVIEW_COLUMNS]
    line = (
        F.when(kind == 0, F.concat_ws("\t", *fields, F.lit("surplus")))
        .when(kind == 1, F.concat_ws("\t", *fields[:-1]))
        .otherwise(F.concat_ws("\t", *fields))
    )
    path = scratch_path(spark, "lines")
    df.select(line.alias("value")).write.text(path)
    return path


@query(
    "scan_skip_bad",
    f"""select {CAST_SQL.replace("cast(star_rating as varchar)",
            f"case when {sql_hash('review_id')} % 10 = 1 then null else cast(star_rating as varchar) end")}
        from reviews where {sql_hash('review_id')} % 10 <> 0""",
    ("reviews",),
)
def scan_skip_bad(spark, sf_dir):
    path = _uneven_lines(spark, sf_dir)
    return files.read_reviews_skip_long(spark, path, header=False)


@query(
    "scan_rejects",
    f"""select concat_ws(chr(9), {', '.join(f"cast({c} as varchar)" for c in REVIEW_COLUMNS)}, 'surplus') as line,
          {len(REVIEW_COLUMNS) + 1}::integer as n_fields,
          '{len(REVIEW_COLUMNS) + 1} fields, {len(REVIEW_COLUMNS)} expected' as reason, true as from_file
        from reviews where {sql_hash('review_id')} % 10 = 0""",
    ("reviews",),
)
def scan_rejects(spark, sf_dir):
    rejects = files.read_rejects(spark, _uneven_lines(spark, sf_dir), header=False)
    return rejects.select("line", "n_fields", "reason", F.col("file").contains("/part-").alias("from_file"))


@query("scan_tsv_wide", f"select {CAST_SQL} from reviews", ("reviews",))
def scan_tsv_wide(spark, sf_dir):
    # Other columns and another order than the rows have; names decide.
    df = view(spark, sf_dir, "reviews").select(
        F.lit("US").alias("marketplace"), *reversed(REVIEW_COLUMNS), F.lit("N").alias("vine")
    )
    path = scratch_path(spark, "wide")
    files.write_csv(df, path, sep="\t")
    return files.read_reviews(spark, path)


QUOTED_SQL = """select review_id, star_rating,
    concat('say "', review_headline, '"', chr(9), 'x') as review_headline,
    concat('"', review_body, '" c', chr(9), 'd', chr(10), 'e') as review_body from reviews"""


@query("scan_tsv_quotes", QUOTED_SQL, ("reviews",))
def scan_tsv_quotes(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").withColumns(
        {
            "review_headline": F.concat(F.lit('say "'), "review_headline", F.lit('"\tx')),
            "review_body": F.concat(F.lit('"'), "review_body", F.lit('" c\td\ne')),
        }
    )
    path = scratch_path(spark, "quotes")
    files.write_csv(df.select(*REVIEW_COLUMNS), path, sep="\t")
    back = files.read_reviews(spark, path, typed=True, multi_line=True)
    return back.select("review_id", "star_rating", "review_headline", "review_body")


@query(
    "scan_skip_wide",
    f"select {CAST_SQL} from reviews where {sql_hash('review_id')} % 10 <> 0",
    ("reviews",),
)
def scan_skip_wide(spark, sf_dir):
    # A tenth of the lines has a field more than the header, which names other columns too.
    names = ["marketplace", *reversed(REVIEW_COLUMNS)]
    fields = [F.lit("US"), *[F.col(c).cast("string") for c in reversed(REVIEW_COLUMNS)]]
    surplus = F.when(bucket("review_id", 10) == 0, "surplus")
    line = F.concat_ws("\t", *fields, surplus).alias("\t".join(names))
    path = scratch_path(spark, "wide-lines")
    files.write_csv(view(spark, sf_dir, "reviews").select(line), path, sep="\x01")
    return files.read_reviews_skip_long(spark, path)


@query(
    "scan_csv_pair",
    f"with {SPLIT_SQL} select split, text, label from parts",
    ("review_raw",),
)
def scan_csv_pair(spark, sf_dir):
    paths = _split_files(spark, sf_dir)
    both = [
        files.read_text_label(spark, p).select(F.lit(n).alias("split"), "text", "label")
        for n, p in paths.items()
    ]
    return both[0].unionByName(both[1])


@query(
    "load_splits",
    f"with {SPLIT_SQL} select split, count(*) as n, sum(label)::bigint as labels from parts group by split",
    ("review_raw",),
)
def load_splits(spark, sf_dir):
    df = files.read_splits(spark, _split_files(spark, sf_dir))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"))


@query("sink_csv", f"with script as ({SCRIPT_SQL}) select text, label from script", ("review_raw",))
def sink_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(clean_script(spark, sf_dir).select("text", "label"), path)
    return files.read_text_label(spark, path)


@query(
    "sink_split_csv",
    f"with {SPLIT_SQL} select split, label, count(*) as n, sum(length(text))::bigint as chars "
    "from parts group by split, label",
    ("review_raw",),
)
def sink_split_csv(spark, sf_dir):
    rows = sampling.split_share(clean_script(spark, sf_dir), 80, seed=1234)
    path = scratch_path(spark, "partitioned")
    files.write_csv(rows.select("text", "label", "split"), path, partition_by=["split"])
    schema = "text string, label int, split string"
    df = spark.read.csv(path, header=True, schema=schema, escape='"')
    return df.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "sink_features",
    """select review_id, len(regexp_split_to_array(regexp_replace(lower(review_body), '\\s+$', ''),
              '\\s')) as n_tokens, 200::bigint as width from review_docs where review_body is not null""",
    ("review_docs",),
)
def sink_features(spark, sf_dir):
    path = scratch_path(spark, "features")
    tf = HashingTF(inputCol="tokens", outputCol="features", numFeatures=200)
    files.write_features(
        tf.transform(tokenized(spark, sf_dir)).select("review_id", "features"), path
    )
    df = spark.read.schema("review_id bigint, features array<double>").parquet(path)
    total = F.aggregate("features", F.lit(0.0).cast("double"), lambda a, x: a + x)
    return df.select(
        "review_id",
        total.cast("bigint").alias("n_tokens"),
        F.size("features").cast("bigint").alias("width"),
    )
