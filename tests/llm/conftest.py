import hashlib
import zlib

import pytest

from starsift.llm import catalog


def crc(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="session")
def documents(sf_dir):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def result(spark, sf_dir):
    """Rows of a query over the smallest tables, computed once."""
    done = {}

    def rows(name):
        if name not in done:
            done[name] = catalog.QUERIES[name](spark, sf_dir).toPandas()
        return done[name]

    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and a column whose name clashes."""
    long = "word " * 30_000
    rows = [
        (1, None, "en", "a", 0, 1), (2, "", "en", None, 0, 2), (2, "", "en", None, 0, 2), (None, "some text here", None, "b", 1, 3),
        (3, long, "en", "a", None, 4), (4, "same words in both of these texts", "en", "a", 1, 5),
        (5, "same words in both of these texts", "de", "b", 1, 6), (6, " \n\t ", "fr", "c", 3, 7), (7, "one", "fr", "c", 3, 8),
        (8, "Ünïcode ſtrange KELVIN \U0001f642  two  blanks\n\nend ", "fr", "c", 3, 9),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score int"
    )


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
