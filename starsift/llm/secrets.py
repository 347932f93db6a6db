"""Secret scan: patterns, and random-looking strings by character Markov models.

Two first-order models of character sequences are trained from labelled
samples, one of random strings and one of ordinary identifiers. A long token
whose log-likelihood ratio speaks for the random one is a secret as well. How
clearly it has to, is chosen on samples that the models have not seen.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.llm.words import utf8

# --- fixed values: patterns of the base scan and least lengths ---
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}
# --- end of fixed values ---
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models judge: characters and least length.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Mean natural-log ratio a character from which a string counts as random, if there are no samples to choose it on.
THRESHOLD = 0.8
#: One text in so many is kept back to choose the threshold; shares of its identifiers and of its random strings
#: that may lie beyond the ends between which it is put.
KEPT_BACK, MOST_WRONG, MOST_MISSED = 20, 0.005, 0.02
#: Words of an identifier that is made as a sample, and its least length.
JOINED, LEAST_SAMPLE = 3, 16
_BINS, _STEP = 400, 0.02
#: Symbols of the models: end of token, and the characters of candidates.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIZE = len(ALPHABET) + 1
_CODE = np.zeros(256, dtype=np.int64)
for _at, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _at + 1


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the patterns' matches, in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= LEAST["access"]]
    # A run of hex digits is whole: the search starts at its first digit.
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _pairs(data: bytes) -> np.ndarray:
    code = _CODE[np.frombuffer(b"\n" + data + b"\n", dtype=np.uint8)]
    return code[:-1] * _SIZE + code[1:]


_NAME_PART = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,}(?![A-Za-z0-9+/_=-])")
#: How names are put together from words.
SHAPES = (
    b"_".join, b"-".join, b"".join, lambda w: b"_".join(w).upper(), lambda w: b"".join(x.capitalize() for x in w),
    lambda w: w[0] + b"".join(x.capitalize() for x in w[1:]),
)


class Model(NamedTuple):
    """Log-likelihood ratio (random over ordinary) of each pair of symbols, and the least mean of a random string."""

    ratios: np.ndarray
    threshold: float = THRESHOLD


def _samples(text: str) -> tuple[list[bytes], list[list[bytes]], bytes]:
    """Random strings (values of the base scan), groups of ordinary words, and the rest of the text."""
    at, plain, secret = 0, [], []
    for start, _, end, first, last in base_spans(text):
        secret.append(text[first:last].encode("ascii", "replace"))
        plain.append(text[at:start])
        at = max(at, end)
    rest = utf8("\n".join([*plain, text[at:]]))
    words = [w.lower() for w in _NAME_PART.findall(rest)]
    groups = [words[i : i + JOINED] for i in range(0, len(words) - JOINED + 1, JOINED)]
    return secret, groups, rest


def _kept_back(doc_id: str = "doc_id"):
    """Whether a text is kept back; decided by its id, a null id is not."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(KEPT_BACK)) == 0, F.lit(False))


def labelled_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Samples of whole texts as counts: (random 0/1, pair of symbols, n).

    Values of the base scan are samples of random strings. All other words, and identifiers made
    of neighbouring words in the customary shapes, are samples of ordinary ones. Each task adds up its
    own; the table has at most two rows per pair of symbols. Null and empty texts have no samples.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, _SIZE * _SIZE), dtype=np.int64)
        for batch in batches:
            for t in batch.text:
                if not t:
                    continue
                secret, groups, rest = _samples(t)
                for value in secret:
                    np.add.at(sums[1], _pairs(value), 1)
                sums[0] += np.bincount(_pairs(rest), minlength=_SIZE * _SIZE)
                for shape in SHAPES:
                    names = b"\n".join(map(shape, groups))
                    sums[0] += np.bincount(_pairs(names), minlength=_SIZE * _SIZE)
        kind, pair = np.nonzero(sums)
        yield pd.DataFrame({"random": kind, "pair": pair, "n": sums[kind, pair]})

    counted = docs.select(F.col(text).alias("text")).mapInPandas(count, "random int, pair long, n long")
    return counted.groupBy("random", "pair").agg(F.sum("n").alias("n"))


def train(counts: DataFrame) -> Model:
    """Ratios of each pair of symbols, add-half smoothed."""
    sums = np.zeros((2, _SIZE * _SIZE))
    for r in counts.collect():  # at most two rows per pair of symbols
        sums[r.random, r.pair] = r.n
    model = sums.reshape(2, _SIZE, _SIZE)
    model[:, 0, 0] = 0
    logp = np.log((model + 0.5) / (model.sum(axis=2, keepdims=True) + 0.5 * _SIZE))
    return Model((logp[1] - logp[0]).reshape(-1))


def calibrate(docs: DataFrame, model: Model, text: str = "text") -> Model:
    """The model with a threshold halfway between the samples of ``docs``.

    ``MOST_WRONG`` of the ordinary identifiers lie above the lower end, ``MOST_MISSED`` of the random strings
    below the upper one. Without random strings, or where the ends cross, it is the larger of
    ``THRESHOLD`` and the lower end; without identifiers it stays as it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, _BINS), dtype=np.int64)
        for batch in batches:
            for t in batch.text:
                secret, groups, _ = _samples(t) if t else ([], [], b"")
                for kind, strings in ((1, secret), (0, [shape(g) for g in groups for shape in SHAPES])):
                    for one in strings:
                        if len(one) >= LEAST_SAMPLE:
                            at = int(shared.value[0][_pairs(one)].mean() / _STEP) + _BINS // 2
                            sums[kind, min(max(at, 0), _BINS - 1)] += 1
        kind, at = np.nonzero(sums)
        yield pd.DataFrame({"random": kind, "bin": at, "n": sums[kind, at]})

    counted = docs.select(F.col(text).alias("text")).mapInPandas(count, "random int, bin int, n long")
    sums = np.zeros((2, _BINS), dtype=np.int64)
    for r in counted.groupBy("random", "bin").agg(F.sum("n").alias("n")).collect():  # at most two rows per bin
        sums[r.random, r.bin] = r.n
    if not sums[0].any():
        return model
    value = lambda at: (at - _BINS // 2) * _STEP
    above = np.append(np.cumsum(sums[0][::-1])[::-1], 0)
    low = value(int(np.argmax(above <= MOST_WRONG * sums[0].sum())))
    below = np.cumsum(sums[1])
    high = value(int(np.argmax(below > MOST_MISSED * sums[1].sum()))) if sums[1].any() else low
    return model._replace(threshold=(low + high) / 2 if high > low else max(low, THRESHOLD))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The models of the texts of ``docs`` and their threshold, chosen on texts that are kept back (by ``doc_id``)."""
    model = train(labelled_counts(docs.where(~_kept_back()), text))
    return calibrate(docs.where(_kept_back()), model, text)


def spans_of(text: str | None, model: Model) -> list[tuple[int, int, int]]:
    """(start, kind, end) of a whole text: the base matches, and candidates apart from them that look random."""
    if not text:
        return []
    base = base_spans(text)
    out = [(s, k, e) for s, k, e, _, _ in base]
    starts = [s for s, *_ in base]
    ends = np.maximum.accumulate([e for _, _, e, _, _ in base]).tolist() if base else []
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that begin before the candidate ends
        if before and ends[before - 1] > m.start():
            continue
        if model.ratios[_pairs(m.group().encode())].mean() >= model.threshold:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def find(docs: DataFrame, model: Model, text: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with an array of (start, kind, end) of whole texts; null texts have none. A column ``out`` is an error."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("array<struct<start:long,kind:string,end:long>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans_of(t, Model(*shared.value))] for t in batch],
                dtype=object,
            )

    return docs.withColumn(out, spans(F.col(text)))


def redact(docs: DataFrame, model: Model, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                parts, at = [], 0
                for start, _, end in spans_of(t, Model(*shared.value)):
                    if start >= at:
                        parts += [t[at:start], mark]
                    at = max(at, end)
                out.append(t if not parts else "".join([*parts, t[at:]]))
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, clean(F.col(text)))


def digests(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, a digest of the base spans, and all spans as text.

    Null and empty texts have none. Very long texts are read whole; repeated rows each for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                found = spans_of(t, Model(*shared.value))
                names = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in found]
                base = ",".join(n for k, n in names if k < 3)
                kinds = [k for k, _ in names]
                rows.append((*map(kinds.count, range(3)), hashlib.sha256(base.encode()).hexdigest(),
                             ",".join(n for _, n in names)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", summed(F.col("text")).alias("d")).select("doc_id", "d.*")
