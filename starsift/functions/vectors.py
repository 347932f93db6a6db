"""Vector scoring: dense layers, softmax, argmax, padding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Layer = tuple[Sequence[Sequence[float]], Sequence[float], str]


def _activate(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(z, 0.0)
    if kind == "softmax":
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    if kind == "linear":
        return z
    raise ValueError(f"unknown activation {kind!r}")


def by_batch(x: pd.Series, run) -> pd.Series:
    """``run`` over the vectors of a batch as one matrix; rows without a vector stay null."""
    out = np.empty(len(x), dtype=object)
    known = np.flatnonzero(x.notna().to_numpy())
    if len(known):
        for i, row in zip(known, run(np.stack(x.iloc[known].to_numpy()).astype(float))):
            out[i] = row
    return pd.Series(out)


def layered(layers: Sequence[Layer]):
    """The stack of layers as a function of a matrix of rows."""
    mats = [(np.asarray(w, float), np.asarray(b, float), kind) for w, b, kind in layers]

    def run(out: np.ndarray) -> np.ndarray:
        for weights, bias, kind in mats:
            out = _activate(out @ weights + bias, kind)
        return out

    return run


def dense(c: Column | str, layers: Sequence[Layer]) -> Column:
    """Scores of a stack of (weights[in][out], bias[out], activation) layers.

    One Arrow batch is one matrix product per layer. The weights travel with
    the task, so this is for classifier heads, not for embedding tables. A null
    vector gives null.
    """
    run = layered(layers)

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        return by_batch(x, run)

    return score(F.col(c) if isinstance(c, str) else c)


def softmax(c: Column | str) -> Column:
    """Softmax of an array of scores, shifted by its maximum."""
    col = F.col(c) if isinstance(c, str) else c
    exps = F.transform(col, lambda x: F.exp(x.cast("double") - F.array_max(col).cast("double")))
    total = F.aggregate(exps, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)


def argmax(c: Column | str) -> Column:
    """Zero-based place of the largest entry; the first one wins a tie."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.array_position(col, F.array_max(col)) - 1).cast("int")


def pad_to(ids: Column | str, width: Column, fill: int = 0) -> Column:
    """``ids`` filled up at the end to ``width``."""
    col = F.col(ids) if isinstance(ids, str) else ids
    gap = F.greatest(width - F.size(col), F.lit(0)).cast("int")
    return F.concat(col, F.array_repeat(F.lit(fill).cast("int"), gap))
