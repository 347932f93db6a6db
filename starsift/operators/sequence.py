"""Token-id sequences: padding, embedding lookup and pooling.

These operators read their input more than once; pass a stored frame if its ids
are costly to make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starsift.functions.vectors import pad_to
from starsift.operators.lookup import HOT_SHARE, MAX_BROADCAST_VALUES, lookup, with_group_stats
from starsift.operators.terms import document_frequency, term_frequency
from starsift.session import stored


def pad_to_longest(df: DataFrame, ids: str = "input_ids", fill: int = 0) -> DataFrame:
    """Pad every sequence to the longest one of the input."""
    width = df.agg(F.max(F.size(ids))).scalar()
    return df.withColumn(ids, pad_to(ids, width, fill))


def pad_per_batch(
    df: DataFrame, batch: str, ids: str = "input_ids", fill: int = 0, share: int = HOT_SHARE
) -> DataFrame:
    """Pad every sequence to the longest one of its batch; rows without a batch are one of their own."""
    sized = with_group_stats(df, [batch], _width=F.max(F.size(ids)), share=share)
    loose = pad_to_longest(df.where(F.col(batch).isNull()), ids, fill)
    return sized.withColumn(ids, pad_to(ids, F.col("_width"), fill)).drop("_width").unionByName(loose)


def _sent(table: DataFrame) -> bool:
    """Whether the vectors are few enough for every task to hold them."""
    values = table.agg(F.coalesce(F.sum(F.size("embedding").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
    return values <= MAX_BROADCAST_VALUES


def token_places(df: DataFrame, tokens: Column | str, *, key: str = "doc_id") -> DataFrame:
    """One row per token position: key, pos, token_id."""
    return df.select(key, F.posexplode(tokens).alias("pos", "token_id"))


def embedding_lookup(
    df: DataFrame,
    table: DataFrame,
    *,
    key: str = "doc_id",
    ids: str = "token_ids",
    share: int = HOT_SHARE,
) -> DataFrame:
    """key, pos, token_id and the vector of every token that is in ``table``.

    A table of checked size goes to the tasks, and nothing is shuffled.
    """
    places = token_places(df, ids, key=key)
    if _sent(table):
        return places.join(F.broadcast(table), "token_id")
    counts = stored(places.groupBy("token_id").agg(F.count(F.lit(1)).alias("n")), "tokens")
    return lookup(places, table, ["token_id"], counts=counts, share=share)


def _weighted_vectors(
    df: DataFrame, table: DataFrame, key: str, ids: str, share: int
) -> DataFrame:
    """One row per (document, distinct token): its count, its vector, the document's size.

    If the table goes to the tasks, a document's rows stay in one task, so they are
    pooled there and a document is shuffled as one row instead of one a token.
    """
    sized = df.withColumn("_size", F.size(ids))
    tf = term_frequency(sized, key=key, tokens=ids, keep=["_size"])
    tf = tf.withColumnRenamed("term", "token_id")
    if _sent(table):
        return tf.join(F.broadcast(table), "token_id")
    counts = document_frequency(df, key=key, tokens=ids).withColumnRenamed("term", "token_id")
    return lookup(tf, table, ["token_id"], counts=stored(counts, "tokens"), n="df", share=share)


def _pool(rows: DataFrame, key: str, dims: int, pool) -> DataFrame:
    """One aggregate per dimension; partial results are combined before the shuffle."""
    cells = rows.groupBy(key).agg(
        *[pool(F.element_at("embedding", i + 1).cast("double")).alias(f"_{i}") for i in range(dims)]
    )
    return cells.select(key, F.array(*[F.col(f"_{i}") for i in range(dims)]).alias("pooled"))


def mean_pool(
    df: DataFrame, table: DataFrame, dims: int, *, key: str = "doc_id",
    ids: str = "token_ids", share: int = HOT_SHARE,
) -> DataFrame:
    """Mean vector over all token positions of a document.

    Positions whose token has no vector count in the divisor; a document without
    any known token has no row.
    """
    rows = _weighted_vectors(df, table, key, ids, share)
    return _pool(rows, key, dims, lambda c: F.sum(c * F.col("tf") / F.col("_size")))


def max_pool(
    df: DataFrame, table: DataFrame, dims: int, *, key: str = "doc_id",
    ids: str = "token_ids", share: int = HOT_SHARE,
) -> DataFrame:
    """Largest value per dimension over all token positions of a document."""
    return _pool(_weighted_vectors(df, table, key, ids, share), key, dims, F.max)
