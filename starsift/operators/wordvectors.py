"""Skip-gram word vectors with negative sampling, trained block by block.

Words have gapless ids by frequency and are dealt to blocks. Centre and context
vectors are tables cut by block. In a round every task trains one (centre block,
context block) pair of its own; over the rounds of an epoch the context blocks
rotate, so that every pair of blocks meets once and no vector is ever
written by two tasks. Pairs of words are counted first and trained once an epoch with
a weight that grows with their count. Nothing holds the vocabulary on the
driver, and a task holds two blocks of vectors and the pairs between them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from starsift.operators.dictionary import with_ids
from starsift.operators.lookup import MAX_BROADCAST_VALUES, lookup
from starsift.operators.terms import term_frequency
from starsift.session import scratch_path, stored

# --- fixed values: training settings ---
VECTOR_SIZE, WINDOW, MIN_COUNT = 100, 5, 5
NEGATIVES, NOISE_POWER = 5, 0.75
WEIGHT_FULL, WEIGHT_POWER = 20.0, 0.75
RATE, EPOCHS = 0.1, 1
# --- end of fixed values ---
#: Words in a block: a task has at most the square of it as distinct pairs.
BLOCK_WORDS = 8192
#: Pairs trained at a time.
BATCH = 2048
_VECTORS = "kind int, block int, id long, v array<float>, s array<float>"


def token_ids(df: DataFrame, vocabulary: DataFrame, *, key: str, tokens: str) -> DataFrame:
    """``key, ids``: the words of each document that have an id, in their order.

    Documents meet the ids by their distinct words, not by their tokens.
    """
    # Term counts are the distinct words of each document, found inside the row.
    counted = stored(term_frequency(df.select(key, tokens), key=key, tokens=tokens).select(key, "term"), "words")
    named = lookup(counted, vocabulary.select("term", "id"), ["term"], counts=vocabulary, n="df")
    words = named.groupBy(key).agg(F.collect_list(F.struct("term", "id")).alias("_words"))
    ids = _named(F.col(tokens), F.col("_words.term"), F.col("_words.id"))
    return df.select(key, tokens).join(words, key).select(key, ids.alias("ids"))


@F.pandas_udf(ArrayType(LongType()))
def _named(tokens: pd.Series, terms: pd.Series, ids: pd.Series) -> pd.Series:
    """Ids of the tokens that have one; a column's map would be searched from its start for every token."""
    lines = []
    for line, own, numbers in zip(tokens, terms, ids):
        known = dict(zip(own, numbers))
        if len(known) < len(own):
            raise ValueError("documents with the same key")
        lines.append([known[t] for t in line if t in known])
    return pd.Series(lines, dtype=object)


def pair_counts(sequences: DataFrame, window: int = WINDOW) -> DataFrame:
    """``centre, context, n`` over all places up to ``window`` apart, in both directions; ids are below 2^31."""

    def pairs(batches):
        for batch in batches:
            held = [np.asarray(ids, dtype=np.int64) for ids in batch.ids if len(ids) > 1]
            if not held:
                continue
            ids = np.concatenate(held)
            text = np.repeat(np.arange(len(held)), [len(h) for h in held])
            found = []
            for step in range(1, window + 1):
                same = text[:-step] == text[step:]
                a, b = ids[:-step][same], ids[step:][same]
                found += [a << 32 | b, b << 32 | a]
            code, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"centre": code >> 32, "context": code & 0xFFFFFFFF, "n": n})

    return (
        sequences.select("ids").mapInPandas(pairs, "centre long, context long, n long")
        .groupBy("centre", "context").agg(F.sum("n").alias("n"))
    )


def _train(centres: np.ndarray, contexts: np.ndarray, sums: tuple, pairs: tuple, noise: np.ndarray, draw, rate: float):
    """One pass over the pairs of two blocks, in place; step sizes fall by the sums of squared gradients."""

    def step(vectors: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        total = np.add.reduceat(gradient.take(order, axis=0), first, axis=0)
        rows = rows[first]
        squares[rows] += (total * total).mean(axis=1)
        total *= rate
        total /= np.sqrt(squares[rows])[:, None]
        vectors[rows] += total

    centre, context, weight = pairs
    order = draw.permutation(len(centre))
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        a, b, w = centre[some], context[some], weight[some]
        # The words drawn as noise are shared by the pairs of a batch.
        other = np.searchsorted(noise, draw.random(max(NEGATIVES, len(some) // 16)) * noise[-1], side="right")
        x, y, z = centres.take(a, axis=0), contexts.take(b, axis=0), contexts.take(other, axis=0)
        gradient = np.empty((len(some) + len(other), x.shape[1]), dtype=x.dtype)
        products = np.multiply(x, y, out=gradient[: len(some)])
        near = w * (1.0 - _sigmoid(products.sum(axis=1)))
        far = _sigmoid(x @ z.T)
        far *= w[:, None]
        far *= -(NEGATIVES / len(other))
        np.multiply(near[:, None], x, out=gradient[: len(some)])
        np.matmul(far.T, x, out=gradient[len(some) :])
        y *= near[:, None]
        y += far @ z
        step(contexts, sums[1], np.concatenate([b, other]), gradient)
        step(centres, sums[0], a, y)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of a matrix of its own, which is overwritten."""
    np.clip(x, -30.0, 30.0, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.divide(1.0, x, out=x)


def train(
    df: DataFrame, *, key: str = "review_id", tokens: str = "tokens", size: int = VECTOR_SIZE, window: int = WINDOW,
    min_count: int = MIN_COUNT, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1234, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``term, id, v``: a vector of ``size`` doubles for each word that occurs ``min_count`` times or more.

    The same rows and seed give the same vectors, whatever the partitioning. Null and empty documents
    have no words. Without any pair the vectors keep their random start; without any word there are no rows.
    """
    spark = df.sparkSession
    counted = term_frequency(df.select(key, tokens), key=key, tokens=tokens)
    totals = counted.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    totals = stored(totals.where(F.col("total") >= min_count), "word-totals")
    vocabulary = stored(
        with_ids(totals, n="total").join(totals.select("term", "df"), "term"), "word-ids"
    )
    words = vocabulary.count()
    blocks = max(1, -(-words // block_words))
    of = lambda c: F.pmod(F.col(c), F.lit(blocks)).cast("int")
    sequences = token_ids(df, vocabulary, key=key, tokens=tokens)
    weight = F.least(F.lit(1.0), F.pow(F.col("n") / F.lit(WEIGHT_FULL), F.lit(WEIGHT_POWER)))
    paired = pair_counts(sequences, window).select(
        of("centre").alias("a"), "centre", "context", weight.cast("float").alias("weight"),
        F.pmod(F.col("context") - F.col("centre"), F.lit(blocks)).cast("int").alias("round"),
    )
    path = scratch_path(spark, "word-pairs")
    paired.write.partitionBy("round").parquet(path)
    pairs = spark.read.schema(paired.schema).parquet(path)
    noise = F.pow(F.col("total").cast("double"), F.lit(NOISE_POWER))

    def start(batches):
        for batch in batches:
            rows = []
            for i in batch.id:
                draw = np.random.default_rng([seed, int(i)])
                rows.append(((draw.random(size) - 0.5) / size).astype(np.float32))
            for kind, own in ((0, rows), (1, [np.zeros(size, dtype=np.float32)] * len(rows))):
                yield pd.DataFrame({
                    "kind": kind, "block": batch.id % blocks, "id": batch.id, "v": own,
                    "s": [np.full(1, 1e-2, dtype=np.float32)] * len(rows),
                })

    vectors = stored(vocabulary.select("id").mapInPandas(start, _VECTORS), "word-vectors")
    chances = vocabulary.select("id", noise.alias("noise"))

    def meet(epoch: int, turn: int):
        def task(vectors: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
            vectors = vectors.sort_values(["kind", "id"], ignore_index=True)
            if not len(vectors) or not len(pairs):
                return vectors[["kind", "block", "id", "v", "s"]]
            pairs = pairs.sort_values(["centre", "context"], ignore_index=True)
            kinds = [vectors[vectors.kind == kind] for kind in (0, 1)]
            x, y = (np.stack(k.v.to_list()).astype(np.float32) for k in kinds)
            sums = tuple(np.concatenate(k.s.to_list()).astype(np.float32) for k in kinds)
            places = [np.searchsorted(k.id.to_numpy(), pairs[c].to_numpy()) for k, c in zip(kinds, ("centre", "context"))]
            draw = np.random.default_rng([seed, epoch, turn, int(pairs.a.iloc[0])])
            _train(x, y, sums, (*places, pairs.weight.to_numpy(np.float32)), np.cumsum(kinds[1].noise.to_numpy()), draw, rate)
            return pd.DataFrame({
                "kind": vectors.kind, "block": vectors.block, "id": vectors.id,
                "v": [*x, *y],
                "s": [s.reshape(1) for s in np.concatenate(sums)],
            })

        return task

    for epoch in range(epochs):
        for turn in range(blocks):
            # A centre block a meets the context block a + turn.
            met = F.pmod(F.col("block") - F.when(F.col("kind") == 1, F.lit(turn)).otherwise(F.lit(0)), F.lit(blocks))
            sides = vectors.join(chances, "id").withColumn("a", met.cast("int"))
            mine = pairs.where(F.col("round") == turn)
            vectors = stored(
                sides.groupBy("a").cogroup(mine.groupBy("a")).applyInPandas(meet(epoch, turn), _VECTORS), "word-vectors"
            )
    return vocabulary.join(vectors.where("kind = 0"), "id").select("term", "id", F.col("v").cast("array<double>").alias("v"))


def document_vectors(
    df: DataFrame, vectors: DataFrame, size: int, *, key: str = "review_id", tokens: str = "tokens", out: str = "embedding"
) -> DataFrame:
    """``key, out``: the sum of the vectors of a document's words over the number of all its tokens.

    Documents without known words, null and empty ones get zeros. ``key`` is unique.
    """
    counted = term_frequency(df.select(key, tokens), key=key, tokens=tokens)
    if vectors.count() * size <= MAX_BROADCAST_VALUES:
        # A document's rows stay in one task and are shuffled as one sum instead of one vector a word.
        rows = counted.join(F.broadcast(vectors.select("term", "v")), "term")
    else:
        counted = stored(counted, "document-words")
        often = stored(counted.groupBy("term").agg(F.count("*").alias("n")), "word-rows")
        rows = lookup(counted, vectors.select("term", "v"), ["term"], counts=often)
    sums = rows.groupBy(key).agg(F.array(*[F.sum(F.col("tf") * F.get("v", F.lit(i))) for i in range(size)]).alias("_sum"))
    n = F.greatest(F.size(tokens), F.lit(1)).cast("double")
    mean = F.transform(F.coalesce("_sum", F.array_repeat(F.lit(0.0).cast("double"), size)), lambda x: x / n)
    return df.select(key, tokens).join(sums, key, "left").select(key, mean.alias(out))


class SkipGram(Estimator, HasInputCol, HasOutputCol):
    """The training above as a pipeline stage; rows need the unique column ``key``."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self.key, self.settings = "review_id", {}
        self._set(**self._input_kwargs)

    def with_settings(self, key: str, **settings) -> SkipGram:
        self.key, self.settings = key, settings
        return self

    def _fit(self, df: DataFrame) -> SkipGramModel:
        vectors = stored(train(df, key=self.key, tokens=self.getInputCol(), **self.settings), "word-vectors")
        model = SkipGramModel(vectors, self.settings.get("size", VECTOR_SIZE), self.key)
        return self._copyValues(model)


class SkipGramModel(Model, HasInputCol, HasOutputCol):
    """Word vectors as a table; adds document vectors for MLlib."""

    def __init__(self, vectors: DataFrame, size: int, key: str):
        super().__init__()
        self.vectors, self.size, self.key = vectors, size, key

    def _transform(self, df: DataFrame) -> DataFrame:
        found = document_vectors(df, self.vectors, self.size, key=self.key, tokens=self.getInputCol(), out="_v")
        return df.join(found, self.key).withColumn(self.getOutputCol(), array_to_vector("_v")).drop("_v")
