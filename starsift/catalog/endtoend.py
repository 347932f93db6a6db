"""The flows from raw reviews to written features, and the rows that the model flows train and test on."""

from __future__ import annotations

from pyspark.sql import functions as F

from starsift.catalog.cleaning import SCRIPT_SQL
from starsift.catalog.fixtures import view
from starsift.catalog.registry import query
from starsift.catalog.relational import MAX_PER_PAIR, MIN_CUSTOMER, MIN_LEN, MIN_PRODUCT, sql_hash
from starsift.plans import flows
from starsift.session import scratch_freed, scratch_path, shuffles_freed
from starsift.sources import files

#: Rows of a class in the network's row query, so that the cap cuts in small tables too.
PER_CLASS = 40

NOTEBOOK_SQL = f"""longs as (select * from reviews where length(review_body) >= {MIN_LEN}),
    capped as (select * from (select *, row_number() over (partition by product_id, customer_id
        order by review_id) as place from longs) x where place <= {MAX_PER_PAIR}),
    pairs as (select distinct product_id, customer_id from capped),
    products as (select product_id from pairs group by product_id having count(*) >= {MIN_PRODUCT}),
    customers as (select customer_id from pairs group by customer_id having count(*) >= {MIN_CUSTOMER}),
    cleaned as (select review_id, product_id, customer_id, star_rating, review_headline || ' ' ||
        substring(regexp_replace(review_body, '<.*?>', '', 'g'), 1, 4000) as review
      from capped semi join products using (product_id) semi join customers using (customer_id)),
    docs as (select review_id, regexp_split_to_array(
        regexp_replace(lower(review), '\\s+$', ''), '\\s') as tokens from cleaned),
    tf as (select review_id, term, count(*) as tf
      from (select review_id, unnest(tokens) as term from docs) x group by review_id, term),
    freq as (select term, count(*) as df from tf group by term),
    ids as (select term, df, row_number() over (order by df desc, term) - 1 as id,
        case when df >= 20 then ln(((select count(*) from docs) + 1)::double / (df + 1)::double)
          else 0::double end as idf from freq)"""


@query(
    "flow_notebook",
    f"""with {NOTEBOOK_SQL} select review_id, product_id, customer_id, star_rating, review,
          count(*) as n_indices, sum(id)::bigint as index_sum, sum(tf)::bigint as count_sum,
          round(max(tf * idf), 6) as top_weight
        from cleaned join tf using (review_id) join ids using (term)
        group by review_id, product_id, customer_id, star_rating, review""",
    ("reviews",),
)
def flow_notebook(spark, sf_dir):
    """Density, cleaning, TF-IDF vectors, attached to the cleaned reviews, written and read back."""
    path = scratch_path(spark, "features")
    with shuffles_freed(spark), scratch_freed(spark):
        rows = flows.notebook_features(
            view(spark, sf_dir, "reviews"), min_chars=MIN_LEN, max_per_pair=MAX_PER_PAIR,
            min_product=MIN_PRODUCT, min_customer=MIN_CUSTOMER,
        )
        files.write_features(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.select(
        "review_id", "product_id", "customer_id", "star_rating", "review",
        F.size("indices").cast("bigint").alias("n_indices"), total("indices").alias("index_sum"),
        total("counts").alias("count_sum"), F.round(F.array_max("weights"), 6).alias("top_weight"),
    )


def _capped_sql(rows: str, n: int) -> str:
    """At most ``n`` rows of a label, first by the seeded hash of the key."""
    first = f"partition by label order by {sql_hash('review_id', 1234)}, review_id"
    return f"(select * from (select *, row_number() over ({first}) as place from {rows}) x where place <= {n})"


@query(
    "flow_tfidf_rows",
    f"""with cleaned as (select * from (select review_id,
             substring(regexp_replace(review_body, '<.*?>', '', 'g'), 1, 2000) as text,
             cast(star_rating as integer) as label from review_raw) x where length(text) >= 20),
          capped as {_capped_sql('cleaned', PER_CLASS)}
        select review_id, text, label,
          case when {sql_hash('review_id', 1234)} % 100 < 90 then 'train' else 'test' end as split,
          cast({sql_hash('review_id', 1235)} % 5 as integer) as fold from capped""",
    ("review_raw",),
)
def flow_tfidf_rows(spark, sf_dir):
    """What the network's flow trains and tests on."""
    rows = flows.tfidf_rows(view(spark, sf_dir, "review_raw"), per_class=PER_CLASS)
    return rows.select("review_id", "text", "label", "split", F.col("fold").cast("int").alias("fold"))


@query(
    "flow_word_vector_rows",
    f"""with script as ({SCRIPT_SQL}), cleaned as (select * from script where text <> ''),
          placed as (select *, row_number() over (order by {sql_hash('review_id', 1234)}, review_id) as nth
                     from cleaned),
          parts as (select review_id, text, label,
              case when nth <= ceil(0.2 * (select count(*) from cleaned)) then 'test' else 'train' end as split
            from placed)
        select review_id, text, label, split,
          cast({sql_hash('review_id', 1235)} % 5 as integer) as fold from parts""",
    ("review_raw",),
)
def flow_word_vector_rows(spark, sf_dir):
    """What the forest's flow trains and tests on: every cleaned review."""
    rows = flows.word_vector_rows(view(spark, sf_dir, "review_raw"))
    return rows.select("review_id", "text", "label", "split", F.col("fold").cast("int").alias("fold"))
