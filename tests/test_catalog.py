"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest
from check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from starsift.catalog import QUERIES, SQL, modelling


def test_registry():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())
    only_rows = set(QUERIES) - set(SQL)
    assert only_rows == {
        "hashing_tf", "word2vec_doc", "mlp_predict", "rf_predict", "cv_mlp", "cv_rf", "best_params", "model_roundtrip",
        "flow_tfidf_mlp", "flow_word2vec_forest",
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    assert compare(df, connect(sf_dir).execute(SQL[name])) == ""


def test_entry(spark, sf_dir):
    rows = entry(spark).collect()
    assert 0 < len(rows) <= 100 and rows[0].df >= rows[-1].df


@pytest.mark.parametrize(("name", "points"), [("cv_mlp", 12), ("cv_rf", 27), ("best_params", None)])
def test_tuning_queries(spark, sf_dir, name, points):
    rows = queries()[name](spark, sf_dir).collect()
    if points:
        assert len(rows) == 5 * points and all(0 <= r.accuracy <= 1 for r in rows)
        assert max(r.accuracy for r in rows) > 0.9
    else:
        assert {"numTrees", "maxDepth"} <= {r.name for r in rows}


@pytest.mark.parametrize("name", ["flow_tfidf_mlp", "flow_word2vec_forest"])
def test_flow_metrics(spark, sf_dir, name):
    """After the searches above, whose ledger they share: one refit each."""
    row = queries()[name](spark, sf_dir).collect()[0]
    test = modelling.labelled_docs(spark, sf_dir).filter("split = 'test'").groupBy("label").count().collect()
    assert row.n_test == sum(r["count"] for r in test)
    assert row.accuracy > max(r["count"] for r in test) / row.n_test  # better than the commonest class
    assert 0 < row.f1 <= 1 and row.mae >= 1 - row.accuracy
