"""Row types of the review files, written out so that no scan infers them."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEW_COLUMNS = [
    "customer_id",
    "review_id",
    "product_id",
    "review_headline",
    "review_body",
    "star_rating",
]

#: Every column as text, as a header-only scan gives it.
REVIEW_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in REVIEW_COLUMNS])

#: The same file with a numeric rating, as a type-inferring scan gives it.
REVIEW_TYPED = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c == "star_rating" else T.StringType())
        for c in REVIEW_COLUMNS
    ]
)

#: One modelling row of train.csv / test.csv.
TEXT_LABEL = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())]
)
