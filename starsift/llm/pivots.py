"""Nearest neighbours by a permutation index.

A vector is represented by its ``prefix`` nearest pivots in order. Rows are dealt
to blocks; a block posts its rows in one inverted file per pivot, with the
pivot's position in the row's order. A query reads the files of its own nearest
pivots, which gives the footrule distance to every row met, ranks by it and
compares the best share on the original vectors. Blocks of queries meet all
blocks of rows, and the nearest of all blocks are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block, and queries in a block.
ROW_BLOCK, QUERY_BLOCK = 8192, 512
#: Vectors the pivots are fitted on.
SAMPLE_ROWS = 10_000
_ROUNDS = 8


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is neither null, empty, zero nor holds a null or non-finite component."""
    x = F.col(column)
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(x.isNotNull() & (F.size(x) > 0) & fit & F.exists(x, lambda v: v != 0))


def fit_pivots(
    vectors: DataFrame, column: str, key: str, pivots: int, sample: int, span: float
) -> np.ndarray:
    """``pivots`` unit vectors: means of the directions in a sample of at most ``sample`` rows.

    Vectors first get a last component that lifts their squared norm to ``span``.

    The sample is the rows whose keys hash lowest; its bound is what reaches the driver.
    """
    low = vectors.select(F.xxhash64(key).alias("h"), column).orderBy("h", column).limit(sample).toPandas()
    x = np.array(low[column].tolist(), dtype=np.float64).reshape(len(low), -1)
    x = np.hstack([x, np.sqrt(np.maximum(0.0, span - (x * x).sum(axis=1)))[:, None]]) / math.sqrt(span)
    centres = x[: min(pivots, len(x))].copy()
    for _ in range(_ROUNDS if len(x) > len(centres) else 0):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    *,
    key: str = "vec_id",
    column: str = "embedding",
    pivots: int = 256,
    prefix: int = 16,
    share: float = 0.8,
    sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """The ``k`` rows of largest inner product found for each query, without the query's own row.

    Returns ``query_id, rank`` (from 1)``, vec_id, score``; equal scores go to the
    smaller id, the score is the double-precision sum over the original vectors.
    ``share`` of the rows that share a pivot with the query, nearest by footrule
    distance, are compared. Rows with unusable vectors (see ``usable``), with a
    null key or of another length than most take no part; a repeated row stands
    once per key and vector. Vectors of unequal norm are indexed with one more component
    that makes their norms equal, so the nearest direction is the largest product.
    """
    spark = rows.sparkSession
    data = usable(rows.select(F.col(key).alias("id"), F.col(column).alias("x")), "x").where("id is not null")
    asked = usable(queries.select(F.col(key).alias("id"), F.col(column).alias("x")), "x").where("id is not null")
    schema = "query_id long, rank int, vec_id long, score double"
    square = F.aggregate("x", F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double") * v.cast("double"))
    shape = data.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("top")) \
        .orderBy(F.col("n").desc(), "dim").first()
    if shape is None:
        return spark.createDataFrame([], schema)
    data, asked = (d.where(F.size("x") == shape.dim).distinct() for d in (data, asked))
    n_asked = asked.count()
    span = float(shape.top)
    centres = fit_pivots(data, "x", "id", pivots, sample, span)
    blocks = max(1, math.ceil(shape.n / ROW_BLOCK))
    groups = max(1, math.ceil(n_asked / QUERY_BLOCK))
    shared = spark.sparkContext.broadcast(centres)
    depth = min(prefix, len(centres))

    def order(x: np.ndarray, lift: bool) -> np.ndarray:
        """The nearest pivots of each vector, nearest first; a lifted vector has the largest norm."""
        centres = shared.value
        more = np.sqrt(np.maximum(0.0, span - (x * x).sum(axis=1))) if lift else np.zeros(len(x))
        near = x @ centres[:, :-1].T + more[:, None] * centres[:, -1]
        return np.argsort(-near, axis=1, kind="stable")[:, :depth]

    def matrix(column: pd.Series) -> np.ndarray:
        return np.array(column.tolist(), dtype=np.float64).reshape(len(column), shape.dim)

    def search(_, some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(some) or not len(block):
            return pd.DataFrame({c: [] for c in names})
        block = block.sort_values("id", kind="stable")
        ids, x = block.id.to_numpy(), matrix(block.x)
        asked_ids, q = some.id.to_numpy(), matrix(some.x)
        posted = order(x, True)
        files = []
        for pivot in range(len(shared.value)):
            row, place = np.nonzero(posted == pivot)
            files.append((row, place))
        out, products = [], q @ x.T
        for one, vector, near, rough in zip(asked_ids, q, order(q, False), products):
            closeness = np.zeros(len(ids), dtype=np.int32)  # depth * (depth + 1) less the footrule
            for place, pivot in enumerate(near):
                row, at = files[pivot]
                closeness[row] += depth - np.maximum(at, place)
            met = np.flatnonzero((closeness > 0) & (ids != one))
            if not len(met):
                continue
            close, budget = closeness[met], max(k, math.ceil(share * len(met)))
            if budget < len(met):  # ties at the edge are all compared
                met = met[close >= np.partition(close, len(met) - budget)[len(met) - budget]]
            # The rough products pick what could be among the k; those are summed again, alike for equal vectors.
            score = rough[met]
            if len(met) > k:
                edge = np.partition(score, len(met) - k)[len(met) - k]
                met = met[score >= edge - 1e-9 * max(1.0, span)]
            score = (x[met] * vector).sum(axis=1)
            top = np.lexsort((ids[met], -score))[:k]
            out.append(pd.DataFrame({"query_id": one, "vec_id": ids[met][top], "score": score[top]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names})

    left = asked.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")) \
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = data.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")) \
        .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
