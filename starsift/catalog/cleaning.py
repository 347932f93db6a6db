"""Cleaning expressions and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from starsift.catalog.fixtures import view
from starsift.catalog.registry import query
from starsift.functions import text as tx
from starsift.plans import flows

# --- fixed values: the cleaning patterns in SQL ---
SQL_URL = r"'\s*https?://\S+(\s+|$)', ' ', 'g'"
SQL_STRIP = r"'^\s+|\s+$', '', 'g'"
# --- end of fixed values ---


def sql_script(text: str) -> str:
    """The script cleaning chain over a SQL text expression."""
    out = f"regexp_replace(regexp_replace({text}, {SQL_URL}), {SQL_STRIP})"
    out = f"regexp_replace({out}, '\\d+', '', 'g')"
    return f"regexp_replace({out}, '[^0-9a-zA-Z ]+', '', 'g')"


SCRIPT_SQL = f"""select review_id,
    {sql_script("concat(review_headline, '.  ', review_body)")} as text,
    cast(star_rating - 1 as integer) as label
  from review_raw where review_headline is not null and review_body is not null"""


@query(
    "strip_html",
    "select page_id, regexp_replace(html, '<.*?>', '', 'g') as body from pages",
)
def strip_html(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", tx.strip_html("html").alias("body"))


@query(
    "remove_urls",
    f"""select review_id, regexp_replace(regexp_replace(review_body, {SQL_URL}), {SQL_STRIP})
          as body from review_raw""",
    ("review_raw",),
)
def remove_urls(spark, sf_dir):
    df = view(spark, sf_dir, "review_raw")
    return df.select("review_id", tx.remove_urls("review_body").alias("body"))


@query(
    "remove_digits",
    "select review_id, regexp_replace(review_body, '\\d+', '', 'g') as body from review_raw",
    ("review_raw",),
)
def remove_digits(spark, sf_dir):
    df = view(spark, sf_dir, "review_raw")
    return df.select("review_id", tx.remove_digits("review_body").alias("body"))


@query(
    "remove_special",
    "select review_id, regexp_replace(review_body, '[^0-9a-zA-Z ]+', '', 'g') as body from review_raw",
    ("review_raw",),
)
def remove_special(spark, sf_dir):
    df = view(spark, sf_dir, "review_raw")
    return df.select("review_id", tx.remove_special("review_body").alias("body"))


@query(
    "truncate_text",
    """select review_id, substring(review_body, 1, 4000) as body4000,
              substring(review_body, 1, 2000) as body2000 from review_docs""",
    ("review_docs",),
)
def truncate_text(spark, sf_dir):
    return view(spark, sf_dir, "review_docs").select(
        "review_id",
        tx.truncate("review_body", 4000).alias("body4000"),
        tx.truncate("review_body", 2000).alias("body2000"),
    )


@query(
    "concat_review",
    "select review_id, review_headline || ' ' || review_body as review from review_docs",
    ("review_docs",),
)
def concat_review(spark, sf_dir):
    df = view(spark, sf_dir, "review_docs")
    return df.select("review_id", tx.join_headline("review_headline", "review_body").alias("review"))


@query(
    "concat_review_dot",
    "select review_id, review_headline || '.  ' || review_body as review from review_docs",
    ("review_docs",),
)
def concat_review_dot(spark, sf_dir):
    text = tx.join_headline("review_headline", "review_body", ".  ")
    return view(spark, sf_dir, "review_docs").select("review_id", text.alias("review"))


@query(
    "clean_notebook",
    """select review_id, customer_id, product_id, star_rating, lang,
              review_headline || ' ' ||
              substring(regexp_replace(review_body, '<.*?>', '', 'g'), 1, 4000) as review
       from review_docs""",
    ("review_docs",),
)
def clean_notebook(spark, sf_dir):
    return flows.clean_notebook(view(spark, sf_dir, "review_docs"))


@query("clean_script", SCRIPT_SQL, ("review_raw",))
def clean_script(spark, sf_dir):
    return flows.clean_script(view(spark, sf_dir, "review_raw"), keep=("review_id",))


@query(
    "clean_tfidf",
    """select * from (select review_id,
           substring(regexp_replace(review_body, '<.*?>', '', 'g'), 1, 2000) as review_body,
           cast(star_rating as integer) as label from review_raw) x
       where length(review_body) >= 20""",
    ("review_raw",),
)
def clean_tfidf(spark, sf_dir):
    return flows.clean_tfidf(view(spark, sf_dir, "review_raw"), keep=("review_id",))


@query(
    "clean_lengths",
    """select review_id, length(review_body) as chars,
              length(regexp_replace(review_body, '<.*?>', '', 'g')) as chars_without_tags
       from review_raw""",
    ("review_raw",),
)
def clean_lengths(spark, sf_dir):
    return view(spark, sf_dir, "review_raw").select(
        "review_id",
        F.length("review_body").cast("bigint").alias("chars"),
        F.length(tx.strip_html("review_body")).cast("bigint").alias("chars_without_tags"),
    )
