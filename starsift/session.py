"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "starsift",
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the operators are written for.

    No master is set unless asked for, so ``spark-submit`` decides. On a
    cluster leave ``shuffle_partitions`` unset at submit time only if the
    default suits the data: AQE merges small partitions but never adds any, so
    the setting is the upper bound of the reduce-side parallelism.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the session's ``spark.checkpoint.dir``.

    All executors must see it, so a machine-local folder is used only when the
    setting is missing and the session itself is local.
    """
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def shared_path(spark: SparkSession, name: str) -> str:
    """The same folder name under the session's ``spark.checkpoint.dir`` whenever asked."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="starsift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/starsift-{name}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of each write or collect when it ends, not only after a driver's collection.

    For jobs that store what they read again: a frame executed twice inside is shuffled twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Folders that ``stored`` has written in the innermost ``scratch_freed`` of this thread.
_inside: ContextVar[list[str] | None] = ContextVar("inside", default=None)


@contextmanager
def scratch_freed(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Frames stored inside lose their files at the end, except those stored by the function that it gives.

    For steps whose last frame is stored, so that nothing reads the ones before it again.
    """
    outer, made = _inside.get(), []
    own = _inside.set(made)

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        path = made.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield kept
    finally:
        _inside.reset(own)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read back.

    Used where several jobs (fits, folds) read one derived frame: a lost
    executor then re-reads files instead of replaying the whole lineage.
    """
    path = scratch_path(df.sparkSession, name)
    if (made := _inside.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
