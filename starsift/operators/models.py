"""Feature stages, grids, cross-validation and scoring on MLlib."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    RegexTokenizer,
    StringIndexer,
    Tokenizer,
)
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from starsift.functions.vectors import Layer, by_batch, layered
from starsift.operators.ledger import Ledger, fingerprint, text_of
from starsift.operators.metrics import best_point, mean_over_folds
from starsift.operators.sampling import fold_frames
from starsift.operators.wordvectors import SkipGram
from starsift.session import stored

# --- fixed values: model settings and hyperparameter grids ---
HASH_FEATURES = 200
HIDDEN_LAYERS = [200, 100, 50]
WORD_VECTOR_SIZE = 100
FOLDS = 5
MLP_GRID = {
    "maxIter": [50, 100, 150, 200],
    "blockSize": [64, 128, 256],
    "stepSize": [0.1, 0.01, 0.02, 0.05],
}
FOREST_GRID = {
    "maxDepth": [4, 10, 15],
    "numTrees": [50, 100, 150],
    "maxBins": [20, 32, 64],
}
LSTM_GRID = {
    "dropout_rate": [0.3, 0.2],
    "lstm_units": [16, 32, 64],
    "num_filters": [16, 32, 64],
    "num_train_epochs": [5, 8, 10],
    "per_device_train_batch_size": [8, 16, 32],
    "learning_rate": [1e-3, 1e-2, 1e-1],
}
TRANSFORMER_GRID = {
    "learning_rate": [1e-3, 1e-2, 1e-1],
    "per_device_train_batch_size": [16, 32, 64, 128, 256],
    "num_train_epochs": [5, 10, 15, 20, 25, 30],
    "weight_decay": [0.01, 0.001],
}
# --- end of fixed values ---

#: Rows in a partition while a classifier is fitted: worth a task, and at most.
FIT_ROWS, MOST_ROWS = 1_024, 100_000
#: stepSize has no effect under the default solver, so tuning leaves it out.
MLP_TUNING_GRID = {k: v for k, v in MLP_GRID.items() if k != "stepSize"}


def label_stage(label: str = "label", out: str = "label_idx") -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=out, handleInvalid="keep")


def tfidf_stages(text: str = "text", out: str = "features", n: int = HASH_FEATURES) -> list:
    return [
        Tokenizer(inputCol=text, outputCol="words"),
        HashingTF(inputCol="words", outputCol="raw_features", numFeatures=n),
        IDF(inputCol="raw_features", outputCol=out),
    ]


def word2vec_stages(
    text: str = "text", out: str = "features", size: int = WORD_VECTOR_SIZE, *, key: str = "review_id", **settings
) -> list:
    """Words and their skip-gram document vectors; ``settings`` are those of ``wordvectors.train``."""
    return [
        RegexTokenizer(inputCol=text, outputCol="words", pattern="\\W"),
        SkipGram(inputCol="words", outputCol=out).with_settings(key, size=size, **settings),
    ]


def perceptron(
    n_in: int, n_out: int, *, label: str = "label_idx", seed: int = 1234, max_iter: int = 100,
    block_size: int = 128, hidden: Sequence[int] = HIDDEN_LAYERS,
) -> MultilayerPerceptronClassifier:
    """The output layer has one unit per class, indexed from 0."""
    return MultilayerPerceptronClassifier(
        layers=[n_in, *hidden, n_out], labelCol=label, seed=seed, maxIter=max_iter,
        blockSize=block_size,
    )


def forest(*, label: str = "label_idx", seed: int = 1234, **params) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, seed=seed, **params)


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the last parameter varying fastest."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def param_maps(estimator: Estimator, grid: Mapping[str, Sequence]) -> list[dict]:
    return [
        {estimator.getParam(name): value for name, value in point.items()}
        for point in grid_points(grid)
    ]


def explode_grid(df: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Each row once per grid point, with one column per parameter."""
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def store_level() -> StorageLevel:
    return StorageLevel.MEMORY_AND_DISK


def _partitions(rows: int, cores: int) -> int:
    """One for so many rows as are worth a task, no more than the cores can use at a time, unless they grew too large."""
    return max(1, min(-(-rows // FIT_ROWS), cores), -(-rows // MOST_ROWS))


def _kept(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns, persisted in partitions that follow their own rows, not the input these were chosen from.

    Every iteration of a network sends the whole gradient from each partition, and every
    level of a forest its statistics, so partitions without work cost the most.
    """
    rows = df.select(*columns).persist(store_level())
    parts = _partitions(rows.count(), df.sparkSession.sparkContext.defaultParallelism)
    if rows.rdd.getNumPartitions() == parts:
        return rows
    dealt = rows.repartition(parts).persist(store_level())
    dealt.count()
    rows.unpersist()
    return dealt


def fit_classifier(
    df: DataFrame, features: Sequence, classifier: Estimator, segment: int | None = None
) -> PipelineModel:
    """Feature stages and classifier fitted in turn, as one model; ``segment`` as in ``cross_validate``.

    A classifier passes over its input many times, so the features are computed
    once and kept while it is fitted; memory pressure moves them to disk.
    """
    stages = Pipeline(stages=list(features)).fit(df)
    columns = [classifier.getOrDefault(c) for c in ("featuresCol", "labelCol")]
    train = _kept(stages.transform(df), columns)
    try:
        if not segment:
            return PipelineModel(stages=[*stages.stages, classifier.fit(train)])
        done, weights, model = 0, None, None
        for upto in _steps(classifier.getMaxIter(), segment):
            model = _fit_segment(classifier, train, {}, done, upto, weights)
            done, weights = upto, model.weights.toArray()
        # The model's settings name all iterations, not those of the last segment.
        model.clear(model.initialWeights)
        return PipelineModel(stages=[*stages.stages, model._set(maxIter=classifier.getMaxIter())])
    finally:
        train.unpersist()


@dataclass
class TunedModel:
    """Result of ``cross_validate``."""

    metrics: DataFrame  # grid_id, params, fold, <metric>
    means: DataFrame  # grid_id, folds, <metric>
    best_id: int
    best_params: dict
    model: PipelineModel | None

    def best_param_frame(self, spark: SparkSession) -> DataFrame:
        """(name, value) of every parameter of the best classifier."""
        values = self.model.stages[-1].extractParamMap()
        rows = sorted((p.name, str(v)) for p, v in values.items())
        return spark.createDataFrame(rows, "name string, value string")


def _chains(grid: Mapping[str, Sequence], segment: int | None) -> list[list[tuple[int, dict]]]:
    """Grid points that one fit after another can serve, by rising ``maxIter``; else each for itself."""
    chains: dict[str, list] = {}
    for i, point in enumerate(grid_points(grid)):
        shared = {n: v for n, v in point.items() if not (segment and n == "maxIter")}
        chains.setdefault(text_of(shared) if segment else str(i), []).append((i, point))
    return [sorted(c, key=lambda x: (x[1].get("maxIter", 0), x[0])) for c in chains.values()]


def _steps(iterations: int, segment: int) -> list[int]:
    return [*range(segment, iterations, segment), iterations]


def _fit_segment(classifier: Estimator, train: DataFrame, point: dict, done: int, upto: int, weights) -> Model:
    """The classifier after iterations ``done`` to ``upto``, from the weights at ``done``."""
    extra = {classifier.getParam(n): v for n, v in {**point, "maxIter": upto - done}.items()}
    if weights is not None:
        extra[classifier.initialWeights] = Vectors.dense(weights)
    return classifier.fit(train, extra)


def cross_validate(
    df: DataFrame,
    features: Sequence,
    classifier: Estimator,
    grid: Mapping[str, Sequence],
    *,
    fold: str = "fold",
    folds: int = FOLDS,
    evaluator: Evaluator | None = None,
    parallelism: int = 1,
    segment: int | None = None,
    ledger: str | None = None,
    refit: bool = True,
) -> TunedModel:
    """Grid search over given folds, then one fit of the best point on all rows.

    Feature stages are fitted on the training rows of each fold only (no
    leakage), and once per fold rather than once per grid point. Every point is
    scored on the held-out fold; the best mean wins, the first point on a tie.

    With ``segment``, a network is trained so many iterations at a time, each
    segment from the weights of the one before (the solver starts anew with them).
    Points that differ in ``maxIter`` alone are then stages of one training.

    With a folder ``ledger``, every finished fit is recorded there. A search over the
    same rows and settings that was stopped reads it and fits only what is
    absent; a fold without anything absent computes no features. Without ``refit`` the
    result has no model.
    """
    spark = df.sparkSession
    evaluator = evaluator or MulticlassClassificationEvaluator(
        labelCol=classifier.getOrDefault("labelCol"), metricName="accuracy"
    )
    metric = evaluator.getMetricName()
    columns = [classifier.getOrDefault(c) for c in ("featuresCol", "labelCol")]
    points, chains = grid_points(grid), _chains(grid, segment)
    df = stored(df, "search")
    run = fingerprint(df, list(features), classifier, metric, segment, folds) if ledger else ""
    record = Ledger(spark, ledger, run)

    def finished(chain: list, k: int) -> bool:
        return all((e := record.get(k, point)) and e.metric is not None for _, point in chain)

    def fit_chain(chain: list, k: int, train: DataFrame, held_out: DataFrame) -> None:
        if not segment:
            for _, point in chain:
                model = classifier.fit(train, {classifier.getParam(n): v for n, v in point.items()})
                record.put(k, point, float(evaluator.evaluate(model.transform(held_out))))
            return
        wanted = {point.get("maxIter", classifier.getMaxIter()): point for _, point in chain}
        done, weights = 0, None
        for upto in sorted({s for most in wanted for s in _steps(most, segment)}):
            point = {**chain[0][1], "maxIter": upto}
            key = wanted.get(upto, point)
            entry = record.get(k, key)
            if entry is None or (upto in wanted and entry.metric is None):
                model = _fit_segment(classifier, train, point, done, upto, weights)
                value = float(evaluator.evaluate(model.transform(held_out))) if upto in wanted else None
                entry = record.put(k, key, value, model.weights.toArray().tolist())
            done, weights = upto, entry.weights

    def fit_fold(k: int, pool: ThreadPoolExecutor) -> None:
        open_chains = [c for c in chains if not finished(c, k)]
        if not open_chains:
            return
        train, held_out = fold_frames(df, k, fold)
        stages = Pipeline(stages=list(features)).fit(train)
        train = _kept(stages.transform(train), columns)
        held_out = _kept(stages.transform(held_out), columns)
        try:
            list(pool.map(lambda c: fit_chain(c, k, train, held_out), open_chains))
        finally:
            train.unpersist()
            held_out.unpersist()

    # Features of one fold are computed while points of another are fitted; ``parallelism`` fits at a time in all.
    with ThreadPoolExecutor(max_workers=parallelism) as pool, ThreadPoolExecutor(max_workers=parallelism) as each:
        list(each.map(lambda k: fit_fold(k, pool), range(folds)))
    rows = [
        (i, ",".join(f"{n}={v}" for n, v in point.items()), k, record.get(k, point).metric)
        for i, point in enumerate(points) for k in range(folds)
    ]
    metrics = spark.createDataFrame(
        rows, f"grid_id int, params string, fold int, {metric} double"
    )
    means = mean_over_folds(metrics, values=[metric])
    best = best_point(means, metric=metric).first()["grid_id"]
    chosen = classifier.copy({classifier.getParam(n): v for n, v in points[best].items()})
    fitted = fit_classifier(df, features, chosen, segment) if refit else None
    return TunedModel(metrics, means, best, points[best], fitted)


def score(model: Model, df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Predictions; with ``labels`` also the class names (``predicted_label``).

    The unit that stands for unseen classes has no name: its label is null.
    """
    scored = model.transform(df)
    if labels is None:
        return scored
    names = F.array(*[F.lit(name) for name in labels])
    return scored.withColumn("predicted_label", F.get(names, F.col("prediction").cast("int")))


def save_and_load(model: PipelineModel, path: str) -> PipelineModel:
    """The model after a round trip through storage."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def batch_score(c: Column | str, predict, returns: str = "array<double>") -> Column:
    """Scores of an external model: ``predict`` maps a 2-D numpy batch to one row each.

    A null vector gives null.
    """

    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        return by_batch(x, predict)

    return run(F.col(c) if isinstance(c, str) else c)


def save_weights(spark: SparkSession, path: str, layers: Sequence[Layer]) -> None:
    """Layers ``(weights[in][out], bias, activation)`` as a table, one row per input unit and one for the bias."""
    rows = []
    for at, (weights, bias, kind) in enumerate(layers):
        rows += [(at, kind, i, [float(w) for w in row]) for i, row in enumerate([*weights, bias])]
    spark.createDataFrame(rows, "layer int, activation string, unit int, weights array<double>").write.mode(
        "overwrite").parquet(path)


def _open_weights(path: str) -> list[Layer]:
    """The layers of ``save_weights``, read where it is called, from any store that Arrow can reach."""
    from pyarrow import dataset, fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (None, path)
    rows = sorted(dataset.dataset(place, filesystem=store, format="parquet").to_table().to_pylist(),
                  key=lambda r: (r["layer"], r["unit"]))
    layers = []
    for _, group in itertools.groupby(rows, key=lambda r: r["layer"]):
        units = list(group)
        layers.append(([u["weights"] for u in units[:-1]], units[-1]["weights"], units[0]["activation"]))
    return layers


def saved_scorer(path: str, width: int, batch_size: int = 1024):
    """A function of a vector column (``width`` components) that gives the scores of the saved layers.

    A worker opens the model once, from ``path`` in storage that all workers reach; the task itself carries the
    path alone. Vectors must not be null.
    """

    def opened():
        run = layered(_open_weights(path))
        return lambda x: run(np.asarray(x, dtype=float))

    return predict_batch_udf(opened, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]])
