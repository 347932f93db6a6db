"""Hit and error rates of the models on strings that they have not seen."""

import base64
import random
import re

import pytest

from starsift.llm import secrets


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return secrets.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def found(text, model):
    return [s for s in secrets.spans_of(f"see {text} here", model) if s[1] == 3]


def test_random_strings_are_found(model):
    draw = random.Random(11)
    kinds = {
        "base62": lambda: "".join(draw.choices(secrets.ALPHABET[:62], k=32)),
        "base64": lambda: base64.b64encode(draw.randbytes(30)).decode(),
        "hex": lambda: draw.randbytes(20).hex().upper(),
    }
    for name, make in kinds.items():
        assert sum(bool(found(make(), model)) for _ in range(400)) >= 0.95 * 400, name


def test_identifiers_are_left_alone(model, documents):
    draw = random.Random(12)
    words = sorted({w.lower() for d in documents if d["lang"] == "en" for w in re.findall(r"\b[A-Za-z]{3,9}\b", d["text"] or "")})
    shapes = {
        "snake": "_".join, "kebab": "-".join, "upper": lambda w: "_".join(w).upper(),
        "camel": lambda w: "".join(x.capitalize() for x in w), "joined": "".join,
        "mixed": lambda w: w[0] + "".join(x.capitalize() for x in w[1:]),
    }
    for name, shape in shapes.items():
        names = [shape(draw.choices(words, k=4)) for _ in range(500)]
        assert sum(bool(found(n, model)) for n in names) <= 0.05 * 500, name
    # Letters of the invented texts differ from English, so these are the harder ones.
    plain = ["getUserAccountBalanceById", "MAX_CONNECTIONS_PER_HOST", "spark_sql_shuffle_partitions", "AbstractSingletonFactoryBean"]
    assert not any(found(n, model) for n in plain)


def test_threshold_is_chosen_on_kept_back_texts(spark):
    rows = [(i, "some plain words that stand here for ordinary prose and names " * 3) for i in range(300)]
    key = lambda seed: "".join(random.Random(seed).choices(secrets.ALPHABET[:62], k=32))
    rows += [(1000 + i, f"secret = {key(i)}") for i in range(200)]
    fitted = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not found("plain_words_that_stand", fitted) and found(key(999), fitted)
    assert fitted.threshold != secrets.THRESHOLD
    with pytest.raises(ValueError):
        secrets.find(spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, found int"), fitted)
