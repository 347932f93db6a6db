"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a whole text: which words, which pairs of neighbours and which pairs
with one word between occur in it, each hashed to ``2 ** BITS`` places. The fit
keeps a learning rate per coordinate and drives weak weights to exactly zero,
so the model is a short list of weights that fits into a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.llm.words import GOLDEN, WordHashes, mix, utf8

BITS = 20
#: Labelled rows the fit may use.
MAX_ROWS = 12_000
#: FTRL-proximal: rate, smoothing of the rate, L2 strength, passes, weight of positive rows.
RATE, SMOOTH, L2, PASSES, POSITIVE = 2.0, 1.0, 0.1, 6, 4.0
#: L1 strengths to choose from, on one training row in so many that is kept back for it.
STRENGTHS, KEPT_BACK = (4.0, 12.0, 30.0), 10
#: Training rows in which a feature has to occur.
LEAST_ROWS = 5

# ASCII letters and digits and all bytes of other characters are kept, A-Z folded.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Distinct feature places of a text; none for a text without words."""
    h = hashes.of(utf8(text).translate(_FOLD).split())
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    parts = [mix(h)]
    for step, salt in ((1, 1), (2, 2)):
        if len(h) > step:
            parts.append(mix((mix(h[:-step]) + np.uint64(salt)) * GOLDEN + h[step:]))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, l1: float) -> tuple[np.ndarray, float]:
    """Weights (mostly zero) and intercept after ``PASSES`` passes over the rows in order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        rate = (SMOOTH + np.sqrt(ni)) / RATE + L2
        w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / rate)
        w[-1] = -zi[-1] / rate[-1]  # the last place is the intercept, without L1
        return w

    for _ in range(PASSES):
        for places, label in zip(rows, labels):
            at = np.append(places, size)
            zi, ni = z[at], n[at]
            wi = weights(zi, ni)
            p = 1.0 / (1.0 + np.exp(-np.clip(wi.sum(), -35, 35)))
            g = (p - label) * (POSITIVE if label else 1.0)
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / RATE * wi
            n[at] = ni + g * g
    w = weights(z, n)
    return w[:size], float(w[size])


def _loss(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, base: float) -> float:
    """Mean logistic loss."""
    sums = np.array([weights[r].sum() for r in rows]) + base
    return float(np.logaddexp(0.0, np.where(labels > 0, -sums, sums)).mean())


def ftrl_chosen(rows: list[np.ndarray], labels: np.ndarray, kept_back: np.ndarray) -> tuple[np.ndarray, float]:
    """``ftrl`` on all rows, with the L1 strength of least loss on the rows kept back from a first fit.

    Features of fewer than ``LEAST_ROWS`` rows are left out. Without rows of both kinds the strongest is taken.
    """
    # One row at a time: all of them side by side would take more memory than the rows themselves.
    times = np.zeros(1 << BITS, dtype=np.int32)
    for r in rows:
        times[r] += 1
    often = times >= LEAST_ROWS
    rows = [r[often[r]] for r in rows]
    best = max(STRENGTHS)
    inside, aside = np.flatnonzero(~kept_back), np.flatnonzero(kept_back)
    if len(inside) and len(aside) and 0 < labels[aside].sum() < len(aside):
        some, others = [rows[i] for i in inside], [rows[i] for i in aside]
        best = min(STRENGTHS, key=lambda l1: _loss(others, labels[aside], *ftrl(some, labels[inside], l1)))
    return ftrl(rows, labels, best)


def held_out(doc_id: str, parts: int = 5, part: int = 0):
    """Whether crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> pd.DataFrame:
    """Places and weights learnt from labelled rows; place -1 is the intercept.

    ``labels``: doc_id and toxic (0/1). Rows with a null id or label are left out, a
    document labelled both ways counts as toxic, and of documents that share an
    id one is used. At most ``max_rows`` documents are used, those whose ids
    hash lowest. They are fitted in one task, in the order of that hash.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id", "toxic", "h").agg(
        F.min("text").alias("text")
    )

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            found = [features(t, hashes).astype(np.int32).tobytes() for t in batch.text]
            yield pd.DataFrame({"h": batch.h, "doc_id": batch.doc_id, "toxic": batch.toxic, "places": found})

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "doc_id"])
        rows = [np.frombuffer(p, dtype=np.int32) for p in group.places]
        aside = group.h.to_numpy() % KEPT_BACK == 0
        weights, base = ftrl_chosen(rows, (group.toxic.to_numpy() > 0).astype(float), aside)
        used = np.flatnonzero(weights)
        return pd.DataFrame({"place": np.append(used, -1), "weight": np.append(weights[used], base)})

    found = rows.mapInPandas(places, "h long, doc_id long, toxic int, places binary").withColumn("fit", F.lit("all"))
    model = found.groupBy("fit").applyInPandas(learn, "place long, weight double").toPandas()
    return model.sort_values("place", ignore_index=True) if len(model) else pd.DataFrame({"place": [-1], "weight": [-4.0]})


def score(docs: DataFrame, model: pd.DataFrame, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability (0 to 1) that the whole text is toxic. A column ``out`` is an error.

    Null and empty texts have no features and get the model's base rate. The model
    has at most ``2 ** BITS`` weights, which bounds what is sent to the tasks.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    base = float(model.weight[model.place == -1].iloc[0])
    used = model[model.place >= 0]
    shared = docs.sparkSession.sparkContext.broadcast(
        (used.place.to_numpy(np.int64), used.weight.to_numpy(np.float64))
    )

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, weights = WordHashes(), np.zeros(1 << BITS)
        weights[shared.value[0]] = shared.value[1]
        for batch in batches:
            sums = np.array([weights[features(t, hashes)].sum() for t in batch], dtype=np.float64) + base
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35))))

    return docs.withColumn(out, toxic(F.col(text)))
