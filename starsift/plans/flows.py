"""The end-to-end flows: two cleaning chains, the TF-IDF chain, feature preparation, and both model flows."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.functions import text as tx
from starsift.operators import density, dictionary, metrics, models, profile, sampling, terms
from starsift.session import scratch_freed, shuffles_freed, stored


def clean_notebook(df: DataFrame, *, max_chars: int = 4000) -> DataFrame:
    """Strip tags, truncate, put headline and body together as ``review``."""
    body = tx.truncate(tx.strip_html("review_body"), max_chars)
    return df.withColumn("review", tx.join_headline("review_headline", body)).drop(
        "review_headline", "review_body"
    )


def clean_script(df: DataFrame, *, drop_empty: bool = False, keep: tuple = ()) -> DataFrame:
    """(text, label): drop nulls, join with '.  ', clean, 0-based int label.

    ``keep`` names columns to carry along (a row key for later splits).
    """
    rows = profile.drop_nulls(df)
    text = tx.join_headline("review_headline", "review_body", ".  ")
    text = tx.remove_special(tx.remove_digits(tx.remove_urls(text)))
    out = rows.select(*keep, text.alias("text"), tx.int_label("star_rating", -1).alias("label"))
    out = out.dropna()
    return out.filter(F.col("text") != "") if drop_empty else out


def clean_tfidf(
    df: DataFrame, *, max_chars: int = 2000, min_chars: int = 20, keep: tuple = ()
) -> DataFrame:
    """(review_body, label): strip tags, truncate, drop short texts."""
    body = tx.truncate(tx.strip_html("review_body"), max_chars)
    rows = df.select(*keep, body.alias("review_body"), tx.int_label("star_rating").alias("label"))
    return profile.min_length(rows, "review_body", min_chars)


def dense_reviews(
    df: DataFrame,
    *,
    min_chars: int = 20,
    max_per_pair: int = 20,
    min_product: int = 2,
    min_customer: int = 2,
    cap_rows: bool = True,
) -> DataFrame:
    """Long-enough reviews of products and customers with enough reviews.

    ``cap_rows`` keeps up to the cap from each pair; otherwise pairs over the
    cap go entirely.
    """
    rows = profile.min_length(profile.drop_nulls(df), "review_body", min_chars)
    if cap_rows:
        # Read for the counts and for the rows; the cap shuffles whole rows, so it is applied once.
        rows = stored(density.pair_cap_topn(rows, max_per_pair), "capped")
    counts = density.stored_pair_counts(rows)
    pairs = density.density_filter(
        counts, max_per_pair=max_per_pair, min_product=min_product, min_customer=min_customer
    )
    return density.join_back_pair(rows, pairs, counts, max_per_pair=max_per_pair)


def prepare_reviews(
    df: DataFrame, *, max_chars: int = 4000, min_df: int | None = 21, **limits
) -> DataFrame:
    """Density filter, notebook cleaning, tokens, and the strict vocabulary filter."""
    cleaned = clean_notebook(dense_reviews(df, **limits), max_chars=max_chars)
    tokens = cleaned.withColumn("tokens", tx.whitespace_tokens("review"))
    if min_df is None:
        return tokens
    return terms.vocab_filter_rows(tokens, min_df=min_df)


def balanced_folds(
    df: DataFrame, per_class: int, *, key: str = "review_id", label: str = "label",
    seed: int = 1234, percent: int = 90, folds: int = 5,
) -> DataFrame:
    """Class-capped rows with a train/test ``split`` and a ``fold``."""
    capped = sampling.balance_classes(df, per_class, label=label, key=key, seed=seed)
    split = sampling.split_share(capped, percent, key=key, seed=seed)
    return sampling.with_fold(split, folds, key=key, seed=seed + 1)


def notebook_features(
    df: DataFrame, *, min_doc_freq: int = 20, max_chars: int = 4000, **limits
) -> DataFrame:
    """Dense, cleaned, distinct reviews with their TF-IDF vectors (``indices, counts, weights``).

    Terms of fewer than ``min_doc_freq`` reviews weigh 0. Rows repeated whole count
    once; ``review_id`` is unique among the rest. A review without a headline or body has
    no text and is left out.
    """
    spark = df.sparkSession
    with shuffles_freed(spark):
        with scratch_freed(spark) as kept:
            cleaned = clean_notebook(dense_reviews(df, **limits), max_chars=max_chars).dropna(subset=["review"])
            # The cleaned rows are read for the terms, their number and the result; the capped ones no more.
            rows = kept(cleaned.distinct(), "cleaned")
        tokens = rows.select("review_id", tx.whitespace_tokens("review").alias("tokens"))
        return terms.attach_features(rows, dictionary.tfidf_vectors(tokens, min_doc_freq=min_doc_freq))


@dataclass
class Trained:
    """A finished model flow."""

    tuned: models.TunedModel
    predictions: DataFrame  # key, label, prediction on the scale of the labels
    metrics: DataFrame  # one row: accuracy, f1, mae, mape, n_test
    seconds: dict[str, float]  # train and score, both forced


def tune_and_score(
    train: DataFrame,
    test: DataFrame,
    features: Sequence,
    classifier: Callable[[int], Estimator],
    grid: Mapping[str, Sequence],
    *,
    key: str = "review_id",
    numeric: bool = True,
    shift: float = 0.0,
    percent: bool = False,
    **search,
) -> Trained:
    """Search over the folds of the train rows, then metrics of the test rows' predictions.

    ``classifier`` makes an estimator for a number of output units: one for each class of
    the train rows, and one for classes seen in the test rows alone. Rows of such a class are
    scored as errors. Predicted indices are mapped back to labels before any error is
    taken, so errors are on the scale of the labels; labels that are not ``numeric`` have
    only their indices, by falling frequency. ``shift`` and ``percent`` as in ``metrics.mape``.
    ``search`` goes to ``models.cross_validate``.
    """
    start = time.monotonic()
    labels = models.label_stage().fit(train)
    tuned = models.cross_validate(
        labels.transform(train), features, classifier(len(labels.labels) + 1), grid, **search
    )
    trained = time.monotonic()
    scored = models.score(tuned.model, labels.transform(test), labels.labels)
    pair = ("label", "predicted_label") if numeric else ("label_idx", "prediction")
    own, guess = (F.col(c).cast("double") for c in pair)
    predictions = stored(scored.select(key, own.alias("label"), guess.alias("prediction")), "predictions")
    done = time.monotonic()
    row = metrics.metric_bundle(predictions, shift=shift, percent=percent).withColumn(
        "n_test", predictions.agg(F.count(F.lit(1))).scalar()
    )
    return Trained(tuned, predictions, row, {"train": trained - start, "score": done - trained})


def tfidf_rows(reviews: DataFrame, *, per_class: int = 23000, key: str = "review_id") -> DataFrame:
    """Cleaned texts, at most ``per_class`` of each rating, with a 90/10 split and five folds."""
    cleaned = clean_tfidf(reviews, keep=(key,)).withColumnRenamed("review_body", "text")
    return balanced_folds(cleaned, per_class, key=key)


def tfidf_network(
    reviews: DataFrame, *, per_class: int = 23000, key: str = "review_id",
    grid: Mapping[str, Sequence] = models.MLP_TUNING_GRID, width: int = models.HASH_FEATURES,
    hidden: Sequence[int] = models.HIDDEN_LAYERS, **search,
) -> Trained:
    """Ratings 1 to 5 from hashed TF-IDF by a tuned network; mape in percent."""
    rows = tfidf_rows(reviews, per_class=per_class, key=key)
    return tune_and_score(
        rows.filter("split = 'train'"), rows.filter("split = 'test'"), models.tfidf_stages(n=width),
        lambda units: models.perceptron(width, units, hidden=hidden), grid,
        key=key, percent=True, **{"parallelism": 5, "segment": 50, **search},
    )


def word_vector_rows(
    reviews: DataFrame, *, train_per_class: int | None = None, test_per_class: int | None = None,
    key: str = "review_id", seed: int = 1234,
) -> DataFrame:
    """Script-cleaned texts with labels from 0, 80/20 exact, with five folds.

    All rows, or at most ``train_per_class`` and ``test_per_class`` of each class, if given.
    """
    # The split and the caps read the rows several times; the texts are cleaned once.
    cleaned = stored(clean_script(reviews, drop_empty=True, keep=(key,)), "cleaned")
    rows = sampling.split_exact(cleaned, 0.2, key=key, seed=seed)
    most = {"train": train_per_class, "test": test_per_class}
    if any(n is not None for n in most.values()):
        parts = {name: rows.filter(F.col("split") == name) for name in most}
        train, test = (
            part if most[name] is None else sampling.balance_classes(part, most[name], key=key, seed=seed)
            for name, part in parts.items()
        )
        rows = train.unionByName(test)
    return sampling.with_fold(rows, models.FOLDS, key=key, seed=seed + 1)


def word_vector_forest(
    reviews: DataFrame, *, train_per_class: int | None = None, test_per_class: int | None = None,
    key: str = "review_id", grid: Mapping[str, Sequence] = models.FOREST_GRID,
    size: int = models.WORD_VECTOR_SIZE, **search,
) -> Trained:
    """Labels 0 to 4 from word vectors by a tuned forest; mape is of the ratings, 1 to 5."""
    rows = word_vector_rows(
        reviews, train_per_class=train_per_class, test_per_class=test_per_class, key=key
    )
    return tune_and_score(
        rows.filter("split = 'train'"), rows.filter("split = 'test'"),
        models.word2vec_stages(size=size, key=key), lambda units: models.forest(), grid,
        key=key, shift=1.0, **{"parallelism": 5, **search},
    )
