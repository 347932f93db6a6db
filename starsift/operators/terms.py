"""Term counts, TF-IDF and vocabulary filters as joins and aggregates.

Nothing here holds a vocabulary on the driver. Input frames have a unique
document key and an array-of-tokens column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starsift.operators.lookup import HOT_KEYS, HOT_SHARE, drop_hot, lookup
from starsift.session import stored


def doc_terms(df: DataFrame, *, key: str = "review_id", tokens: str = "tokens") -> DataFrame:
    """Distinct (document, term) rows; made distinct inside each row, without a shuffle."""
    return df.select(key, F.explode(F.array_distinct(tokens)).alias("term"))


def document_frequency(
    df: DataFrame, *, key: str = "review_id", tokens: str = "tokens"
) -> DataFrame:
    """Number of documents per term: term, df."""
    return doc_terms(df, key=key, tokens=tokens).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")
    )


def term_frequency(
    df: DataFrame, *, key: str = "review_id", tokens: str = "tokens", keep: Sequence[str] = ()
) -> DataFrame:
    """Occurrences of each term in each document: key, term, tf.

    A document is one row, so its tokens are counted inside the row, as runs of
    the sorted array; nothing is shuffled. Null tokens do not count. ``keep`` names columns to
    carry along.
    """
    rows = df.select(key, *keep, F.sort_array(F.array_compact(tokens)).alias("_sorted"))
    size, item = F.size("_sorted"), F.col("_sorted")
    # Places (from 1) where a run begins; null for an empty document.
    begins = F.filter(
        F.sequence(F.lit(1), size), lambda i: (i == 1) | (item[i - 1] != item[i - 2])
    )
    rows = rows.withColumn("_begins", F.when(size > 0, begins))
    runs = F.transform(
        "_begins",
        lambda begin, j: F.struct(
            item[begin - 1].alias("term"),
            (F.coalesce(F.get("_begins", j + 1), size + 1) - begin).cast("bigint").alias("tf"),
        ),
    )
    return rows.select(key, *keep, F.inline(runs))


def idf_weight(n_docs: Column, min_doc_freq: int = 0) -> Column:
    """ln((n_docs + 1) / (df + 1)); 0 below ``min_doc_freq``."""
    idf = F.log((n_docs + F.lit(1)).cast("double") / (F.col("df") + 1).cast("double"))
    if min_doc_freq:
        idf = F.when(F.col("df") >= min_doc_freq, idf).otherwise(F.lit(0.0).cast("double"))
    return idf


def idf_weights(frequencies: DataFrame, n_docs: Column, min_doc_freq: int = 0) -> DataFrame:
    """term, df, idf (see ``idf_weight``)."""
    return frequencies.select("term", "df", idf_weight(n_docs, min_doc_freq).alias("idf"))


def tfidf(
    df: DataFrame,
    *,
    key: str = "review_id",
    tokens: str = "tokens",
    min_doc_freq: int = 0,
    share: int | None = None,
    most: int = HOT_KEYS,
) -> DataFrame:
    """key, term, tf, df, idf, tfidf for every term of every document.

    The commonest terms (``most`` at most, or those above ``share``, see ``lookup``) hold most of
    the rows and take the broadcast side of the lookup, so only rows of rarer terms are shuffled.
    The texts are read once for the terms, whose counts are written and read again.
    """
    tf = stored(term_frequency(df, key=key, tokens=tokens), "term-counts")
    # A document has one row per term, so its frequency is a count of these rows.
    frequencies = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    weights = idf_weights(frequencies, n_docs, min_doc_freq)
    hot = {"most": most} if share is None else {"share": share}
    joined = lookup(tf, weights, ["term"], counts=frequencies, n="df", **hot)
    return joined.select(
        key, "term", "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("tfidf")
    )


def attach_features(details: DataFrame, features: DataFrame, key: str = "review_id") -> DataFrame:
    """Detail rows with their term rows, joined on the unique document key.

    Only the key, the features and the wanted details should be passed in; a
    document's share of the rows is at most its own number of terms. The details, a row per
    document, are the side that is hashed, so the many term rows are not sorted.
    """
    return details.hint("shuffle_hash").join(features, key)


def vocab_filter_rows(
    df: DataFrame,
    *,
    key: str = "review_id",
    tokens: str = "tokens",
    min_df: int = 21,
    share: int = HOT_SHARE,
) -> DataFrame:
    """Documents all of whose terms occur in at least ``min_df`` documents.

    The default keeps a review only if each of its tokens is in at least 20
    other reviews. The surviving keys are found first, so the texts themselves
    move only if the key list is too large for a broadcast.
    """
    terms = doc_terms(df, key=key, tokens=tokens)
    frequencies = stored(document_frequency(df, key=key, tokens=tokens), "terms")
    rest = drop_hot(terms, frequencies, ["term"], n="df", floor=min_df, share=share)
    rare = frequencies.filter(F.col("df") < min_df).select("term")
    failed = rest.join(rare, "term", "left_semi").select(key).distinct()
    kept = df.select(key).join(failed, key, "left_anti")
    return df.join(kept, key, "left_semi")


def vocab_filter_tokens(
    df: DataFrame,
    *,
    key: str = "review_id",
    tokens: str = "tokens",
    min_df: int = 21,
    share: int = HOT_SHARE,
) -> DataFrame:
    """Every document without its rare tokens, order and repeats kept.

    Only the positions of rare tokens are shuffled and brought back; the
    positions to keep are then one set difference of integers per document.
    """
    places = df.select(key, F.posexplode(tokens).alias("_pos", "term"))
    frequencies = stored(document_frequency(df, key=key, tokens=tokens), "terms")
    rest = drop_hot(places, frequencies, ["term"], n="df", floor=min_df, share=share)
    rare = frequencies.filter(F.col("df") < min_df).select("term")
    rare_places = (
        rest.join(rare, "term", "left_semi")
        .groupBy(key)
        .agg(F.collect_list("_pos").alias("_rare"))
    )
    joined = df.join(rare_places, key, "left")
    every = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    kept = F.transform(
        F.array_except(every, "_rare"), lambda i: F.element_at(F.col(tokens), i + 1)
    )
    return joined.withColumn(
        tokens, F.when(F.col("_rare").isNull(), F.col(tokens)).otherwise(kept)
    ).drop("_rare")


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n, idx: classes by falling frequency, ties in alphabetical order.

    The rank runs over one row per class, the same table that MLlib's
    ``StringIndexer`` keeps on the driver.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), F.col(label).cast("string"))
    return counts.withColumn("idx", (F.row_number().over(order) - 1).cast("double"))
