"""Projections, filters, density, joins, aggregates, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from starsift.catalog.fixtures import view
from starsift.catalog.registry import query
from starsift.functions import text as tx
from starsift.functions.hashing import bucket
from starsift.operators import density, profile, sampling, setops
from starsift.session import scratch_path

# Thresholds at which each filter removes some rows of the benchmark tables.
MIN_LEN = 24
MAX_PER_PAIR = 20
MIN_PRODUCT = 30
MIN_CUSTOMER = 35
PER_CLASS = 2000


def sql_hash(key: str, seed: int | None = None) -> str:
    text = f"cast({key} as varchar)"
    if seed is not None:
        text = f"concat_ws('|', {text}, '{seed}')"
    return f"('0x'||substr(md5({text}),1,8))::BIGINT"


PAIRS_SQL = f"""pairs as (select product_id, customer_id, count(review_id) as n_reviews
    from reviews where length(review_body) >= {MIN_LEN}
    group by product_id, customer_id having count(review_id) <= {MAX_PER_PAIR})"""
DENSE_SQL = f"""{PAIRS_SQL},
    p as (select product_id, count(*) as product_review_count from pairs group by product_id),
    c as (select customer_id, count(*) as customer_review_count from pairs group by customer_id),
    dense as (select product_id, customer_id, n_reviews, product_review_count, customer_review_count
      from pairs join p using (product_id) join c using (customer_id)
      where product_review_count >= {MIN_PRODUCT} and customer_review_count >= {MIN_CUSTOMER})"""


def long_reviews(spark, sf_dir):
    return profile.min_length(view(spark, sf_dir, "reviews"), "review_body", MIN_LEN)


def capped_pairs(spark, sf_dir):
    counts = density.stored_pair_counts(long_reviews(spark, sf_dir))
    return density.pair_cap_having(counts, MAX_PER_PAIR)


def dense_pairs(counts):
    return density.density_filter(
        counts,
        max_per_pair=MAX_PER_PAIR,
        min_product=MIN_PRODUCT,
        min_customer=MIN_CUSTOMER,
    )


def all_and_dense_pairs(spark, sf_dir):
    """Pair counts of all reviews, and the dense pairs of the long ones; the reviews are built once for both."""
    long = F.length("review_body") >= MIN_LEN
    counts, of_long = density.stored_pair_counts_within(view(spark, sf_dir, "reviews"), long)
    return counts, dense_pairs(of_long)


# ---- projections, filters, profile ----


@query("row_count", "select count(*) as n from reviews", ("reviews",))
def row_count(spark, sf_dir):
    return view(spark, sf_dir, "reviews").agg(F.count(F.lit(1)).alias("n"))


@query(
    "project_review_cols",
    """select customer_id, review_id, product_id, review_headline, review_body, star_rating
       from reviews""",
    ("reviews",),
)
def project_review_cols(spark, sf_dir):
    return view(spark, sf_dir, "reviews").select(
        "customer_id", "review_id", "product_id", "review_headline", "review_body", "star_rating"
    )


@query(
    "project_label",
    """select review_id, try_cast(cast(star_rating as varchar) as integer) as label,
              try_cast(review_headline as integer) as headline_number from reviews""",
    ("reviews",),
)
def project_label(spark, sf_dir):
    df = view(spark, sf_dir, "reviews")
    return df.select(
        "review_id",
        tx.int_label(F.col("star_rating").cast("string")).alias("label"),
        tx.int_label("review_headline").alias("headline_number"),
    )


NULLS_SQL = """select count(*) filter (review_id is null) as review_id,
              count(*) filter (customer_id is null) as customer_id,
              count(*) filter (product_id is null) as product_id,
              count(*) filter (review_headline is null) as review_headline,
              count(*) filter (review_body is null) as review_body,
              count(*) filter (star_rating is null) as star_rating,
              count(*) filter (score is null or isnan(score)) as score
       from (select *, case when review_id % 13 = 0 then 'nan'::double
                            else cast(star_rating as double) end as score from review_docs) x"""


def _with_nan(spark, sf_dir):
    df = view(spark, sf_dir, "review_docs").drop("lang")
    score = F.when(F.col("review_id") % 13 == 0, F.lit(float("nan"))).otherwise(
        F.col("star_rating").cast("double")
    )
    return df.withColumn("score", score)


@query("null_profile", NULLS_SQL, ("review_docs",))
def null_profile(spark, sf_dir):
    return profile.null_profile(_with_nan(spark, sf_dir))


@query(
    "null_profile_observed",
    NULLS_SQL.replace("select count(*)", "select count(*) as n_rows, count(*)", 1),
    ("review_docs",),
)
def null_profile_observed(spark, sf_dir):
    """The same counts, taken while the rows are written."""
    done = profile.write_profiled(_with_nan(spark, sf_dir), scratch_path(spark, "profiled"))
    return done.profile().withColumn("n_rows", F.lit(done.n_rows).cast("bigint"))


@query(
    "drop_nulls",
    """select review_id, review_headline, star_rating from review_docs
       where review_headline is not null and review_body is not null""",
    ("review_docs",),
)
def drop_nulls(spark, sf_dir):
    df = profile.drop_nulls(view(spark, sf_dir, "review_docs"))
    return df.select("review_id", "review_headline", "star_rating")


@query(
    "min_length",
    f"select review_id, review_body from reviews where length(review_body) >= {MIN_LEN}",
    ("reviews",),
)
def min_length(spark, sf_dir):
    return long_reviews(spark, sf_dir).select("review_id", "review_body")


@query(
    "class_filter",
    "select review_id, star_rating from reviews where star_rating in (1, 5)",
    ("reviews",),
)
def class_filter(spark, sf_dir):
    df = view(spark, sf_dir, "reviews")
    return df.filter(F.col("star_rating").isin(1, 5)).select("review_id", "star_rating")


@query(
    "drop_columns",
    "select review_id, customer_id, product_id, star_rating from reviews",
    ("reviews",),
)
def drop_columns(spark, sf_dir):
    return view(spark, sf_dir, "reviews").drop("review_headline", "review_body")


@query(
    "rename_columns",
    "select review_id, review_body as text, star_rating as label from reviews",
    ("reviews",),
)
def rename_columns(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").select("review_id", "review_body", "star_rating")
    return df.withColumnsRenamed({"review_body": "text", "star_rating": "label"})


@query(
    "label_shift",
    """select review_id, cast(star_rating - 1 as integer) as label,
              cast(star_rating as integer) as restored from reviews""",
    ("reviews",),
)
def label_shift(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").select(
        "review_id", tx.int_label("star_rating", -1).alias("label")
    )
    return df.withColumn("restored", tx.int_label("label", 1))


# ---- density ----


@query(
    "pair_counts",
    """select product_id, customer_id, count(review_id) as n_reviews from reviews
       group by product_id, customer_id""",
    ("reviews",),
)
def pair_counts(spark, sf_dir):
    return density.pair_counts(view(spark, sf_dir, "reviews"))


@query(
    "pair_counts_max",
    """select product_id, customer_id, max(n) as review_id from
         (select product_id, customer_id, count(review_id) as n from reviews
          group by product_id, customer_id having count(review_id) <= 20) x
       group by product_id, customer_id""",
    ("reviews",),
)
def pair_counts_max(spark, sf_dir):
    # The maximum of one count per pair is that count, so there is no second aggregate.
    counts = density.pair_counts(view(spark, sf_dir, "reviews"))
    pairs = density.pair_cap_having(counts, MAX_PER_PAIR)
    return pairs.withColumnRenamed("n_reviews", "review_id")


@query(
    "pair_cap_having",
    f"with {PAIRS_SQL} select * from pairs",
    ("reviews",),
)
def pair_cap_having(spark, sf_dir):
    return density.pair_cap_having(density.pair_counts(long_reviews(spark, sf_dir)), MAX_PER_PAIR)


@query(
    "pair_cap_topn",
    f"""select review_id, product_id, customer_id from
          (select *, row_number() over (partition by product_id, customer_id order by review_id) as rn
           from reviews) x where rn <= {MAX_PER_PAIR}""",
    ("reviews",),
)
def pair_cap_topn(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").select("review_id", "product_id", "customer_id")
    return density.pair_cap_topn(df, MAX_PER_PAIR)


@query(
    "product_review_count",
    f"""with {PAIRS_SQL} select product_id, customer_id, n_reviews, product_review_count from pairs
        join (select product_id, count(*) as product_review_count from pairs group by product_id) x
        using (product_id)""",
    ("reviews",),
)
def product_review_count(spark, sf_dir):
    pairs = capped_pairs(spark, sf_dir)
    counts = density.product_review_count(pairs)
    return density.lookup(pairs, counts, ["product_id"], counts=counts, n="product_review_count")


@query(
    "customer_review_count",
    f"""with {PAIRS_SQL} select product_id, customer_id, n_reviews, customer_review_count from pairs
        join (select customer_id, count(*) as customer_review_count from pairs group by customer_id) x
        using (customer_id)""",
    ("reviews",),
)
def customer_review_count(spark, sf_dir):
    pairs = capped_pairs(spark, sf_dir)
    counts = density.customer_review_count(pairs)
    return density.lookup(pairs, counts, ["customer_id"], counts=counts, n="customer_review_count")


@query("density_filter", f"with {DENSE_SQL} select * from dense", ("reviews",))
def density_filter(spark, sf_dir):
    return dense_pairs(density.stored_pair_counts(long_reviews(spark, sf_dir)))


@query(
    "join_back_pair",
    f"""with {DENSE_SQL} select review_id, product_id, customer_id, star_rating from reviews r
        where length(review_body) >= {MIN_LEN} and exists (select 1 from dense d
          where d.product_id = r.product_id and d.customer_id = r.customer_id)""",
    ("reviews",),
)
def join_back_pair(spark, sf_dir):
    rows = long_reviews(spark, sf_dir)
    counts = density.stored_pair_counts(rows)
    back = density.join_back_pair(rows, dense_pairs(counts), counts, max_per_pair=MAX_PER_PAIR)
    return back.select("review_id", "product_id", "customer_id", "star_rating")


@query(
    "join_back_customer",
    f"""with {DENSE_SQL} select customer_id, count(*) as joined_rows,
          count(distinct review_id) as detail_rows,
          count(*) // count(distinct review_id) as copies
        from dense join reviews using (customer_id) group by customer_id""",
    ("reviews",),
)
def join_back_customer(spark, sf_dir):
    counts, dense = all_and_dense_pairs(spark, sf_dir)
    return density.fan_out_sizes(dense, counts)


@query(
    "join_back_customer_rows",
    f"""with {DENSE_SQL} select review_id, r.customer_id, copies from reviews r
        join (select customer_id, count(*) as copies from dense group by customer_id) d
        on r.customer_id = d.customer_id""",
    ("reviews",),
)
def join_back_customer_rows(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").select("review_id", "customer_id")
    counts, dense = all_and_dense_pairs(spark, sf_dir)
    back = density.join_back_customer(df, dense, counts)
    return back.select("review_id", "customer_id", "copies")


@query(
    "join_strategy_hint",
    f"""with {PAIRS_SQL},
        s as (select product_id, count(*) as reviews, avg(cast(star_rating as double)) as stars
              from reviews group by product_id),
        j as (select product_id, count(*) as pairs, max(reviews) as reviews,
                     round(max(stars), 6) as stars
              from pairs join s using (product_id) group by product_id)
        select 'merge' as strategy, * from j union all select 'shuffle_hash' as strategy, * from j""",
    ("reviews",),
)
def join_strategy_hint(spark, sf_dir):
    rows = view(spark, sf_dir, "reviews")
    stars = rows.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.avg(F.col("star_rating").cast("double")).alias("stars"),
    )
    # Combined per product before the join, so that a hot product is one row.
    capped = density.pair_cap_having(
        density.pair_counts(long_reviews(spark, sf_dir)), MAX_PER_PAIR
    )
    pairs = capped.groupBy("product_id").agg(F.count(F.lit(1)).alias("pairs"))

    def joined(strategy):
        return pairs.join(stars.hint(strategy), "product_id").select(
            F.lit(strategy).alias("strategy"),
            "product_id",
            "pairs",
            "reviews",
            F.round("stars", 6).alias("stars"),
        )

    return setops.union_all([joined("merge"), joined("shuffle_hash")])


# ---- sampling and splits ----


@query(
    "scan_capped",
    f"""select review_id, star_rating from reviews
        order by {sql_hash('review_id')}, review_id limit 10000""",
    ("reviews",),
)
def scan_capped(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").select("review_id", "star_rating")
    return sampling.take_first(df, 10000, key="review_id")


@query(
    "limit_sample",
    f"""select review_id, star_rating from reviews
        order by {sql_hash('review_id', 1)}, review_id limit 1000""",
    ("reviews",),
)
def limit_sample(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").select("review_id", "star_rating")
    return sampling.take_first(df, 1000, key="review_id", seed=1)


@query(
    "seeded_sample",
    f"""select review_id, star_rating from reviews
        order by {sql_hash('review_id', 42)}, review_id limit 10000""",
    ("reviews",),
)
def seeded_sample(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").select("review_id", "star_rating")
    return sampling.take_first(df, 10000, key="review_id", seed=42)


CAPPED_SQL = f"""capped as (select review_id, label, review_body from
    (select review_id, star_rating as label, review_body,
            row_number() over (partition by star_rating
              order by {sql_hash('review_id')}, review_id) as rn from reviews) x
    where rn <= {PER_CLASS})"""


def labelled(spark, sf_dir):
    return view(spark, sf_dir, "reviews").select(
        "review_id", F.col("star_rating").alias("label"), "review_body"
    )


@query("class_balance_cap", f"with {CAPPED_SQL} select * from capped", ("reviews",))
def class_balance_cap(spark, sf_dir):
    return sampling.balance_classes(labelled(spark, sf_dir), PER_CLASS)


@query(
    "split_hash_90_10",
    f"""select review_id, case when {sql_hash('review_id', 1234)} % 100 < 90 then 'train'
          else 'test' end as split from reviews""",
    ("reviews",),
)
def split_hash_90_10(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").select("review_id")
    return sampling.split_share(df, 90, seed=1234)


@query(
    "split_exact_80_20",
    f"""select review_id, case when row_number() over (order by {sql_hash('review_id', 7)}, review_id)
          <= (select ceil(count(*) * 0.2::double) from reviews) then 'test' else 'train' end as split
        from reviews""",
    ("reviews",),
)
def split_exact_80_20(spark, sf_dir):
    df = view(spark, sf_dir, "reviews").select("review_id")
    return sampling.split_exact(df, 0.2, seed=7)


# Six of seven rows lose their key; the limit and the split reach into those.
KEYLESS_SQL = f"""keyless as (select review_id, star_rating,
    case when {sql_hash('review_id')} % 7 = 0 then review_id end as review_key from reviews)"""


def _keyless(spark, sf_dir):
    key = F.when(bucket("review_id", 7) == 0, F.col("review_id"))
    return view(spark, sf_dir, "reviews").select("review_id", "star_rating", key.alias("review_key"))


@query(
    "take_first_null_keys",
    f"""with {KEYLESS_SQL} select review_key from keyless
        order by review_key is null, {sql_hash('review_key')}, review_key limit 10000""",
    ("reviews",),
)
def take_first_null_keys(spark, sf_dir):
    return sampling.take_first(_keyless(spark, sf_dir), 10000, key="review_key").select("review_key")


@query(
    "split_exact_null_keys",
    f"""with {KEYLESS_SQL} select review_key, case when row_number() over (
              order by review_key is null, {sql_hash('review_key', 7)}, review_key)
          <= (select ceil(count(*) * 0.2::double) from keyless) then 'test' else 'train' end as split
        from keyless""",
    ("reviews",),
)
def split_exact_null_keys(spark, sf_dir):
    df = sampling.split_exact(_keyless(spark, sf_dir), 0.2, key="review_key", seed=7)
    return df.select("review_key", "split")


@query(
    "kfold_assign",
    f"select review_id, cast({sql_hash('review_id', 42)} % 5 as integer) as fold from reviews",
    ("reviews",),
)
def kfold_assign(spark, sf_dir):
    return sampling.with_fold(view(spark, sf_dir, "reviews").select("review_id"), 5, seed=42)


@query(
    "kfold_sizes",
    f"""with f as (select cast({sql_hash('review_id', 42)} % 5 as integer) as fold from reviews)
        select k as fold, count(*) filter (fold <> k) as train_rows,
               count(*) filter (fold = k) as eval_rows
        from f, (select distinct fold as k from f) g group by k""",
    ("reviews",),
)
def kfold_sizes(spark, sf_dir):
    return sampling.fold_sizes(kfold_assign(spark, sf_dir))


# ---- set operations ----


@query(
    "union_slices",
    f"""with {CAPPED_SQL} select review_id, label from capped where label = 1 union all
        select review_id, label from capped where label = 3 union all
        select review_id, label from capped where label = 5""",
    ("reviews",),
)
def union_slices(spark, sf_dir):
    # One scan with a class list gives the union of the per-class slices.
    return sampling.balance_classes(
        labelled(spark, sf_dir).select("review_id", "label"), PER_CLASS, classes=[1, 3, 5]
    )


@query(
    "union_splits",
    f"""select split, label, count(*) as n from
          (select case when {sql_hash('review_id', 1234)} % 100 < 90 then 'train' else 'test' end
             as split, star_rating as label from reviews) x group by split, label""",
    ("reviews",),
)
def union_splits(spark, sf_dir):
    rows = sampling.split_share(labelled(spark, sf_dir), 90, seed=1234)
    parts = {name: rows.filter(F.col("split") == name).drop("split") for name in ("train", "test")}
    both = setops.union_named(parts)
    return both.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "except_rows",
    f"""select review_body, label, list_aggregate(words, 'string_agg', ' ') as words from
        (select review_body, star_rating as label, string_split(lower(review_body), ' ') as words
           from reviews
         except select review_body, star_rating, string_split(lower(review_body), ' ')
           from reviews where {sql_hash('review_id')} % 2 = 0) x""",
    ("reviews",),
)
def except_rows(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    part = rows.filter(sampling.bucket("review_id", 2) == 0)

    def worded(df):
        # Repeats go before the words are made, while the rows are narrow.
        narrow = setops.distinct_rows(df.select("review_body", "label"))
        return narrow.withColumn("words", tx.whitespace_tokens("review_body"))

    left = setops.except_rows(worded(rows), worded(part))
    return left.withColumn("words", F.array_join("words", " "))


@query(
    "split_complement",
    f"""with {CAPPED_SQL} select review_id, star_rating as label from reviews
        where review_id not in (select review_id from capped)""",
    ("reviews",),
)
def split_complement(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("review_id", "label")
    return setops.complement(rows, sampling.balance_classes(rows, PER_CLASS))


@query(
    "distinct_rows",
    "select distinct product_id, review_headline, review_body, star_rating from reviews",
    ("reviews",),
)
def distinct_rows(spark, sf_dir):
    df = view(spark, sf_dir, "reviews")
    return setops.distinct_rows(
        df.select("product_id", "review_headline", "review_body", "star_rating")
    )


@query("distinct_texts", "select distinct text, lang from documents")
def distinct_texts(spark, sf_dir):
    return setops.distinct_rows(view(spark, sf_dir, "documents").select("text", "lang"))
