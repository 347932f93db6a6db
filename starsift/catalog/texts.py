"""Tokens, term counts, TF-IDF, vocabulary filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from starsift.catalog.fixtures import view
from starsift.catalog.registry import query
from starsift.functions import text as tx
from starsift.operators import dictionary, terms

WS_SQL = r"regexp_split_to_array(regexp_replace(lower(review_body), '\s+$', ''), '\s')"
TOKENS_SQL = f"""docs as (select review_id, product_id, star_rating, {WS_SQL} as tokens
    from review_docs where review_body is not null)"""
TERMS_SQL = f"""{TOKENS_SQL},
    tf as (select review_id, term, count(*) as tf
           from (select review_id, unnest(tokens) as term from docs) x group by review_id, term),
    freq as (select term, count(*) as df from tf group by term),
    nd as (select count(*) as n from docs)"""
IDF_SQL = "ln((n + 1)::double / (df + 1)::double)"


def tokenized(spark, sf_dir):
    df = view(spark, sf_dir, "review_docs").filter(F.col("review_body").isNotNull())
    return df.select(
        "review_id", "product_id", "star_rating",
        tx.whitespace_tokens("review_body").alias("tokens"),
    )


def _joined(df):
    return df.select(
        "review_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join("tokens", " ").alias("tokens"),
    )


@query(
    "tokenize_ws",
    f"""with {TOKENS_SQL} select review_id, len(tokens) as n_tokens,
          array_to_string(tokens, ' ') as tokens from docs""",
    ("review_docs",),
)
def tokenize_ws(spark, sf_dir):
    return _joined(tokenized(spark, sf_dir))


@query(
    "tokenize_regex",
    """select review_id, len(tokens) as n_tokens, array_to_string(tokens, ' ') as tokens from
        (select review_id, regexp_extract_all(lower(review_body), '[a-z0-9_]+') as tokens
         from review_docs where review_body is not null) x""",
    ("review_docs",),
)
def tokenize_regex(spark, sf_dir):
    df = view(spark, sf_dir, "review_docs").filter(F.col("review_body").isNotNull())
    return _joined(df.select("review_id", tx.word_tokens("review_body").alias("tokens")))


STOP = [*tx.ENGLISH_STOPWORDS, tx.EXTRA_STOPWORD]
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP)


@query(
    "stopword_remove",
    f"""with {TOKENS_SQL} select review_id, len(kept) as n_tokens,
          array_to_string(kept, ' ') as tokens from
          (select review_id, list_filter(tokens, lambda t: t not in ({_STOP_SQL})) as kept from docs) x""",
    ("review_docs",),
)
def stopword_remove(spark, sf_dir):
    df = tokenized(spark, sf_dir)
    return _joined(df.withColumn("tokens", tx.remove_stopwords("tokens", STOP)))


@query("doc_frequency", f"with {TERMS_SQL} select term, df from freq", ("review_docs",))
def doc_frequency(spark, sf_dir):
    return terms.document_frequency(tokenized(spark, sf_dir))


@query("term_frequency", f"with {TERMS_SQL} select review_id, term, tf from tf", ("review_docs",))
def term_frequency(spark, sf_dir):
    return terms.term_frequency(tokenized(spark, sf_dir))


@query(
    "idf_weights",
    f"with {TERMS_SQL} select term, df, round({IDF_SQL}, 6) as idf from freq, nd",
    ("review_docs",),
)
def idf_weights(spark, sf_dir):
    df = tokenized(spark, sf_dir)
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    weights = terms.idf_weights(terms.document_frequency(df), n_docs)
    return weights.withColumn("idf", F.round("idf", 6))


@query(
    "tfidf",
    f"""with {TERMS_SQL} select review_id, term, tf, df, round(tf * {IDF_SQL}, 6) as tfidf
        from tf join freq using (term), nd""",
    ("review_docs",),
)
def tfidf(spark, sf_dir):
    weights = terms.tfidf(tokenized(spark, sf_dir))
    return weights.select("review_id", "term", "tf", "df", F.round("tfidf", 6).alias("tfidf"))


@query(
    "idf_min_doc_freq",
    f"""with {TERMS_SQL} select review_id, term, tf,
          case when df >= 20 then round(tf * {IDF_SQL}, 6) else 0::double end as tfidf
        from tf join freq using (term), nd""",
    ("review_docs",),
)
def idf_min_doc_freq(spark, sf_dir):
    weights = terms.tfidf(tokenized(spark, sf_dir), min_doc_freq=20)
    return weights.select("review_id", "term", "tf", F.round("tfidf", 6).alias("tfidf"))


@query(
    "vocab_filter_rows",
    f"""with {TERMS_SQL} select review_id, len(tokens) as n_tokens from docs
        where review_id not in (select review_id from tf join freq using (term) where df < 21)""",
    ("review_docs",),
)
def vocab_filter_rows(spark, sf_dir):
    kept = terms.vocab_filter_rows(tokenized(spark, sf_dir), min_df=21)
    return kept.select("review_id", F.size("tokens").cast("bigint").alias("n_tokens"))


@query(
    "vocab_filter_rows_loose",
    f"""with {TERMS_SQL} select review_id, len(tokens) as n_tokens from docs
        where review_id not in (select review_id from tf join freq using (term) where df < 3)""",
    ("review_docs",),
)
def vocab_filter_rows_loose(spark, sf_dir):
    kept = terms.vocab_filter_rows(tokenized(spark, sf_dir), min_df=3)
    return kept.select("review_id", F.size("tokens").cast("bigint").alias("n_tokens"))


@query(
    "vocab_filter_tokens",
    f"""with {TERMS_SQL},
        pos as (select review_id, unnest(tokens) as term, generate_subscripts(tokens, 1) as i from docs),
        kept as (select review_id, count(*) as n_tokens, string_agg(term, ' ' order by i) as tokens
                 from pos join freq using (term) where df >= 21 group by review_id)
        select review_id, coalesce(n_tokens, 0) as n_tokens, coalesce(kept.tokens, '') as tokens
        from docs left join kept using (review_id)""",
    ("review_docs",),
)
def vocab_filter_tokens(spark, sf_dir):
    return _joined(terms.vocab_filter_tokens(tokenized(spark, sf_dir), min_df=21))


@query(
    "attach_features",
    f"""with {TERMS_SQL} select review_id, product_id, star_rating, term, tf, df
        from docs join tf using (review_id) join freq using (term)""",
    ("review_docs",),
)
def attach_features(spark, sf_dir):
    df = tokenized(spark, sf_dir)
    details = df.select("review_id", "product_id", "star_rating")
    features = terms.tfidf(df).select("review_id", "term", "tf", "df")
    return terms.attach_features(details, features)


@query(
    "label_index",
    """select label, n, (row_number() over (order by n desc, label) - 1)::double as idx
       from (select lang as label, count(*) as n from review_docs group by lang) x""",
    ("review_docs",),
)
def label_index(spark, sf_dir):
    return terms.label_index(view(spark, sf_dir, "review_docs"), "lang").withColumnRenamed(
        "lang", "label"
    )


@query(
    "count_vectors",
    f"""with {TERMS_SQL}, ids as (
          select term, row_number() over (order by df desc, term) - 1 as id from freq where df >= 2)
        select review_id, term, id, tf from tf join ids using (term)""",
    ("review_docs",),
)
def count_vectors(spark, sf_dir):
    return dictionary.count_terms(tokenized(spark, sf_dir), min_df=2)


@query(
    "count_vectors_sparse",
    f"""with {TERMS_SQL}, ids as (
          select term, row_number() over (order by df desc, term) - 1 as id from freq where df >= 2),
        v as (select review_id, count(*) as n, sum(id) as ids, sum(tf) as total, max(id) as last
              from tf join ids using (term) group by review_id)
        select review_id, coalesce(n, 0) as n_indices, coalesce(ids, 0)::bigint as index_sum,
          coalesce(total, 0)::bigint as count_sum, coalesce(last, -1) as last_index
        from docs left join v using (review_id)""",
    ("review_docs",),
)
def count_vectors_sparse(spark, sf_dir):
    rows = dictionary.count_vectors(tokenized(spark, sf_dir), min_df=2)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "review_id", F.size("indices").cast("bigint").alias("n_indices"), total("indices").alias("index_sum"),
        total("counts").alias("count_sum"),
        F.coalesce(F.try_element_at("indices", F.lit(-1)), F.lit(-1)).cast("bigint").alias("last_index"),
    )
