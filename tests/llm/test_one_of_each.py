"""Which rows stay, against a plain comparison of texts."""

import corpus_pipeline

A = " ".join(f"w{i}" for i in range(60))
NEAR = A.replace("w59", "x")
OTHER = " ".join(f"z{i}" for i in range(40))


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "")
    assert out.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_texts_decide_and_not_ids(spark):
    rows = [(None, A), (None, NEAR), (1, A), (5, NEAR), (5, OTHER)]
    assert kept(spark, rows) == sorted([(1, A), (5, OTHER)], key=repr)


def test_null_ids_repeats_and_texts_without_words(spark):
    rows = [(None, A), (None, NEAR), (None, A), (7, None), (7, None), (8, ""), (9, OTHER), (9, OTHER), (2, " \n")]
    got = kept(spark, rows)
    assert [r for r in got if r[1] in (A, NEAR)] in ([(None, A)], [(None, NEAR)])
    assert [r for r in got if r[1] not in (A, NEAR)] == sorted([(7, None), (7, None), (8, ""), (9, OTHER), (2, " \n")], key=repr)
    assert kept(spark, []) == []
