"""Review files in and out: TSV and CSV scans, named splits, CSV and Parquet sinks."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starsift.operators.profile import as_missing
from starsift.operators.setops import union_named
from starsift.schema import REVIEW_TEXT, REVIEW_TYPED, TEXT_LABEL

# --- fixed values: texts that a default pandas.read_csv takes as missing ---
PANDAS_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# --- end of fixed values ---



def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table.

    ``partitions`` redistributes the rows round-robin, for a file whose few row
    groups would leave most cores idle up to the first shuffle.
    """
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df


def _wanted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by name, each cast; values that cannot be cast are null."""
    absent = [name for name in schema.names if name not in df.columns]
    if absent:
        raise ValueError(f"columns {absent} are not in the header {df.columns}")
    return df.select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_reviews(
    spark: SparkSession,
    path: str,
    *,
    typed: bool = False,
    partitions: int | None = None,
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Tab-separated reviews; all text, or with an int rating.

    Columns are found by the names in the header, in any order and among others;
    a missing one is an error. Without ``header`` they are taken by position.
    ``partitions`` redistributes the rows round-robin, which is only of use when
    the file cannot be split; a scan with as many tasks or more stays as it is. ``multi_line`` allows line breaks inside quotes; such
    a file is read by one task.
    """
    schema = REVIEW_TYPED if typed else REVIEW_TEXT
    options = {"sep": "\t", "escape": '"', "multiLine": multi_line}
    if header:
        df = _wanted(spark.read.csv(path, header=True, **options), schema)
    else:
        df = spark.read.csv(path, header=False, schema=schema, **options)
    return df.repartition(partitions) if partitions and df.rdd.getNumPartitions() < partitions else df


def _field_count(line: Column, sep: str) -> Column:
    """Fields of a line; separators inside quotes do not count."""
    mark = re.escape(sep)
    bare = F.regexp_replace(line, f'(^|{mark})"(?:[^"]|"")*"', "$1")
    return F.least(*[F.regexp_count(text, F.lit(mark)) for text in (line, bare)]) + 1


def _data_lines(
    spark: SparkSession, path: str, schema: T.StructType, sep: str, header: bool
) -> tuple[DataFrame, list[str] | None]:
    """The lines that hold rows (``value``, ``_metadata``), and the names of their fields; None without a header line."""
    lines = spark.read.text(path).filter(F.col("value") != "")
    if not header:
        return lines, schema.names
    first = lines.first()
    if first is None:
        return lines, None
    names = next(csv.reader([first["value"].removeprefix("\ufeff")], delimiter=sep))
    absent = [name for name in schema.names if name not in names]
    if absent:
        raise ValueError(f"columns {absent} are not in the header {names}")
    return lines.filter(F.col("value") != first["value"]), names


def read_reviews_skip_long(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType = REVIEW_TEXT,
    sep: str = "\t",
    na_values: Sequence[str] = PANDAS_NA,
    header: bool = True,
) -> DataFrame:
    """Scan that skips lines with too many fields and pads lines with too few.

    ``DROPMALFORMED`` would drop both kinds, and the CSV source cannot tell an
    empty surplus field from none, so long lines are dropped as text and the
    rest is parsed. With ``header`` the first line gives the names and the number of
    fields, and the columns of ``schema`` are found by name; lines equal to it are
    headers of other parts. Without it they are taken by position.
    """
    lines, names = _data_lines(spark, path, schema, sep, header)
    if names is None:
        return spark.createDataFrame([], schema)
    fits = lines.filter(_field_count(F.col("value"), sep) <= len(names))
    texts = ", ".join(f"_c{i} string" for i in range(len(names)))
    row = F.from_csv("value", texts, {"sep": sep, "escape": '"'}).alias("_row")
    picked = [F.col(f"_row._c{names.index(name)}").alias(name) for name in schema.names]
    clean = as_missing(fits.select(row).select(*picked), na_values)
    return clean.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_rejects(
    spark: SparkSession, path: str, *, schema: T.StructType = REVIEW_TEXT, sep: str = "\t", header: bool = True
) -> DataFrame:
    """The lines that ``read_reviews_skip_long`` skips: file, line, n_fields, reason.

    Together with its rows these are all lines but empty ones and headers. Lines
    with too few fields are padded there, so they are not among them.
    """
    lines, names = _data_lines(spark, path, schema, sep, header)
    width = len(names or schema.names)
    found = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"),
        _field_count(F.col("value"), sep).alias("n_fields"),
    )
    why = F.concat(F.col("n_fields").cast("string"), F.lit(f" fields, {width} expected"))
    return found.filter(F.col("n_fields") > width).withColumn("reason", why)


def read_text_label(
    spark: SparkSession, path: str, *, schema: T.StructType = TEXT_LABEL, multi_line: bool = False
) -> DataFrame:
    """A CSV with a header, as the sinks below write it; columns are found by name.

    ``multi_line`` is needed only if texts hold line breaks; such a file is read
    by one task, so keep the files small then (``max_rows_per_file``).
    """
    return _wanted(spark.read.csv(path, header=True, escape='"', multiLine=multi_line), schema)


def read_splits(
    spark: SparkSession, paths: Mapping[str, str], *, schema: T.StructType = TEXT_LABEL
) -> DataFrame:
    """Several files as one frame with a ``split`` column."""
    return union_named({n: read_text_label(spark, p, schema=schema) for n, p in paths.items()})


def write_csv(
    df: DataFrame,
    path: str,
    *,
    sep: str = ",",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    one_file: bool = False,
    max_rows_per_file: int | None = None,
) -> None:
    """CSV with a header. ``one_file`` sends all rows through one task: small results only."""
    out = (df.coalesce(1) if one_file else df).write.mode(mode)
    if max_rows_per_file:
        out = out.option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.csv(
        path, header=True, sep=sep, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_splits(df: DataFrame, paths: Mapping[str, str], *, split: str = "split") -> None:
    """One CSV per named split, without the split column."""
    for name, path in paths.items():
        write_csv(df.filter(F.col(split) == name).drop(split), path)


def write_features(df: DataFrame, path: str, *, fmt: str = "parquet") -> None:
    """A frame with feature vectors: arrays in Parquet, JSON text in CSV."""
    vectors = [f.name for f in df.schema.fields if isinstance(f.dataType, VectorUDT)]
    arrays = df.withColumns({v: vector_to_array(v) for v in vectors})
    if fmt == "parquet":
        arrays.write.parquet(path)
    elif fmt == "csv":
        write_csv(arrays.withColumns({v: F.to_json(v) for v in vectors}), path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
