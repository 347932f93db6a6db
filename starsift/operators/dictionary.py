"""A frequency dictionary with gapless ids, and sparse count vectors over it.

No step sorts or numbers the whole vocabulary in one task: terms are ordered by
range, each task numbers its own, and the ids of a range begin where the ranges
before it end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.operators.lookup import HOT_KEYS, lookup
from starsift.operators.numbering import numbered
from starsift.operators.terms import document_frequency, idf_weight, term_frequency
from starsift.session import stored


def with_ids(counts: DataFrame, *, term: str = "term", n: str = "df", least: int = 1) -> DataFrame:
    """``term, n, id``: ids from 0 by falling ``n``, ties by the term, for terms counted ``least`` times or more.

    ``counts`` has one row per term; null terms get no id.
    """
    kept = counts.where((F.col(n) >= least) & F.col(term).isNotNull()).select(term, n)
    return numbered(kept, [F.col(n).desc(), F.col(term)], "id")


def count_terms(df: DataFrame, *, key: str = "review_id", tokens: str = "tokens", min_df: int = 1) -> DataFrame:
    """``key, term, id, tf`` of the terms that stand in ``min_df`` documents or more."""
    counted = stored(term_frequency(df.select(key, tokens), key=key, tokens=tokens), "term-counts")
    # A document has one row per term, so its frequency is a count of these rows.
    frequencies = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ids = stored(with_ids(frequencies, least=min_df), "term-ids")
    named = lookup(counted, ids.select("term", "id"), ["term"], counts=ids, n="df", most=HOT_KEYS)
    return named.select(key, "term", "id", "tf")


def count_vectors(df: DataFrame, *, key: str = "review_id", tokens: str = "tokens", min_df: int = 1) -> DataFrame:
    """``key, indices, counts``: a sparse vector per document, ids ascending; without known terms both are empty.

    A document's vector is as long as its distinct terms, so no group is larger than a document.
    """
    pair = F.array_sort(F.collect_list(F.struct("id", "tf")))
    rows = count_terms(df, key=key, tokens=tokens, min_df=min_df).groupBy(key).agg(pair.alias("pairs"))
    none = F.array().cast("array<bigint>")
    return df.select(key).join(rows, key, "left").select(
        key, F.coalesce("pairs.id", none).alias("indices"), F.coalesce("pairs.tf", none).alias("counts")
    )


def tfidf_vectors(
    df: DataFrame, *, key: str = "review_id", tokens: str = "tokens", min_doc_freq: int = 0
) -> DataFrame:
    """``key, indices, counts, weights``: sparse TF-IDF vectors over all terms, ids ascending.

    Terms of fewer than ``min_doc_freq`` documents keep their place with a weight of 0.
    Documents without terms get empty vectors. The terms are counted from ``df`` for the dictionary and
    again for the vectors, since their rows are more than the texts; pass a stored frame.
    """
    counted = term_frequency(df.select(key, tokens), key=key, tokens=tokens)
    ids = stored(with_ids(counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))), "term-ids")
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    weights = ids.select("term", "id", idf_weight(n_docs, min_doc_freq).alias("idf"))
    rows = lookup(counted, weights, ["term"], counts=ids, n="df", most=HOT_KEYS)
    entry = F.struct("id", "tf", (F.col("tf") * F.col("idf")).alias("weight"))
    vectors = rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_v"))
    kinds = {"indices": ("id", "bigint"), "counts": ("tf", "bigint"), "weights": ("weight", "double")}
    return df.select(key).join(vectors, key, "left").select(
        key,
        *[F.coalesce(F.col(f"_v.{field}"), F.array().cast(f"array<{kind}>")).alias(name)
          for name, (field, kind) in kinds.items()],
    )


def vocabulary(df: DataFrame, *, key: str = "review_id", tokens: str = "tokens", min_df: int = 1) -> DataFrame:
    """``term, df, id`` of all terms of the documents."""
    return with_ids(document_frequency(df, key=key, tokens=tokens), least=min_df)
