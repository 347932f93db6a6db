"""Review density: caps per (product, customer) pair, minimum counts, join-backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starsift.operators.lookup import HOT_KEYS, HOT_SHARE, drop_hot, lookup
from starsift.session import stored

PRODUCT = "product_id"
CUSTOMER = "customer_id"
PAIR = [PRODUCT, CUSTOMER]


def pair_counts(df: DataFrame) -> DataFrame:
    """Reviews per (product, customer): product_id, customer_id, n_reviews."""
    rows = df.filter(F.col(PRODUCT).isNotNull() & F.col(CUSTOMER).isNotNull())
    return rows.groupBy(*PAIR).agg(F.count("review_id").alias("n_reviews"))


def stored_pair_counts(df: DataFrame) -> DataFrame:
    """``pair_counts`` written once: the operators below read it several times."""
    return stored(pair_counts(df), "pairs")


def stored_pair_counts_within(df: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """``pair_counts`` of all rows and of the rows ``inside``, from one pass; written once."""
    rows = df.filter(F.col(PRODUCT).isNotNull() & F.col(CUSTOMER).isNotNull()).withColumn("_in", inside)
    both = stored(
        rows.groupBy(*PAIR).agg(
            F.count("review_id").alias("n_reviews"),
            # A test for null, so that a key that cannot be null need not be made.
            F.count_if(F.col("_in") & F.col("review_id").isNotNull()).alias("_n_in"),
            F.count_if("_in").alias("_rows_in"),
        ),
        "pairs",
    )
    within = both.filter(F.col("_rows_in") > 0).select(*PAIR, F.col("_n_in").alias("n_reviews"))
    return both.select(*PAIR, "n_reviews"), within


def pair_cap_having(counts: DataFrame, max_per_pair: int = 20) -> DataFrame:
    """Pairs with at most ``max_per_pair`` reviews; larger pairs go entirely."""
    return counts.filter(F.col("n_reviews") <= max_per_pair)


def pair_cap_topn(df: DataFrame, max_per_pair: int = 20, order_by: str = "review_id") -> DataFrame:
    """Up to ``max_per_pair`` reviews of each pair, first by ``order_by``.

    The rank filter becomes a group limit that prunes each map task to the cap
    before the shuffle, so a hot pair arrives as a few rows per task.
    """
    rank = F.row_number().over(W.partitionBy(*PAIR).orderBy(order_by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= max_per_pair).drop("_rank")


def product_review_count(pairs: DataFrame) -> DataFrame:
    """Surviving pairs per product."""
    return pairs.groupBy(PRODUCT).agg(F.count(F.lit(1)).alias("product_review_count"))


def customer_review_count(pairs: DataFrame) -> DataFrame:
    """Surviving pairs per customer."""
    return pairs.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("customer_review_count"))


def density_filter(
    counts: DataFrame,
    *,
    max_per_pair: int = 20,
    min_product: int = 2,
    min_customer: int = 2,
    share: int | None = None,
) -> DataFrame:
    """Pairs under the cap whose product and customer both have enough pairs.

    Takes the stored pair counts. Both review counts are taken over the same
    capped pairs, before either minimum is applied. Products and customers above ``share`` of the
    pairs are looked up by broadcast, or by default the commonest ``HOT_KEYS``.
    """
    hot = {"most": HOT_KEYS} if share is None else {"share": share}
    pairs = pair_cap_having(counts, max_per_pair)
    products = product_review_count(pairs)
    customers = customer_review_count(pairs)
    kept = lookup(
        pairs,
        products.filter(F.col("product_review_count") >= min_product),
        [PRODUCT],
        counts=products,
        n="product_review_count",
        **hot,
    )
    return lookup(
        kept,
        customers.filter(F.col("customer_review_count") >= min_customer),
        [CUSTOMER],
        counts=customers,
        n="customer_review_count",
        **hot,
    )


def join_back_pair(
    df: DataFrame,
    pairs: DataFrame,
    counts: DataFrame,
    *,
    max_per_pair: int = 20,
    share: int = HOT_SHARE,
) -> DataFrame:
    """Review rows of ``df`` whose (product, customer) pair is in ``pairs``.

    ``counts`` are the stored pair counts of ``df``. Pairs over the cap cannot be
    in ``pairs``, so the rows of any hot pair are dropped before the shuffle.
    """
    rows = drop_hot(df, counts, PAIR, n="n_reviews", floor=max_per_pair + 1, share=share)
    return rows.join(pairs.select(*PAIR), PAIR, "left_semi")


def join_back_customer(
    df: DataFrame, pairs: DataFrame, counts: DataFrame, *, share: int | None = None
) -> DataFrame:
    """Review rows of the customers in ``pairs``, with their join multiplicity.

    Joining on the customer alone repeats every review once per surviving pair
    of its customer. The repeats are given as a column ``copies`` rather than as
    rows: same information, and the size stays that of the input. ``counts`` are
    the stored pair counts of ``df``. Customers above ``share`` of the rows meet them by broadcast,
    or by default the commonest ``HOT_KEYS``, so that rows are shuffled for rarer ones only.
    """
    rows = df.dropna(subset=[CUSTOMER])
    sizes = counts.groupBy(CUSTOMER).agg(F.sum("n_reviews").alias("n"))
    copies = pairs.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("copies"))
    hot = {"most": HOT_KEYS} if share is None else {"share": share}
    return lookup(rows, copies, [CUSTOMER], counts=stored(sizes, "sizes"), n="n", **hot)


def fan_out_sizes(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows per customer of the customer-only join, without making those rows."""
    details = counts.groupBy(CUSTOMER).agg(F.sum("n_reviews").alias("detail_rows"))
    copies = pairs.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("copies"))
    return details.join(copies, CUSTOMER).select(
        CUSTOMER,
        "detail_rows",
        "copies",
        (F.col("detail_rows") * F.col("copies")).alias("joined_rows"),
    )
