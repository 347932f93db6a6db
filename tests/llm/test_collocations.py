"""Phrases from the graph against plain counts."""

import re
from collections import Counter

import pytest

from starsift.llm import collocations

ROWS = "group string, rank long, phrase string, a long, l long, r long, n long, score long"


def plain(docs, longest, least, top):
    out = []
    for lang in {d[0] or "und" for d in docs}:
        f = Counter()
        for _, text in [d for d in docs if (d[0] or "und") == lang]:
            low = (text or "").translate({c: c + 32 for c in range(65, 91)})
            for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                w = tuple(re.findall("[^\x20\x09]+", piece))
                f.update(w[i : i + k] for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if c >= least}
        rows = []
        for p, a in often.items():
            longer = [q for q in often if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if len(p) == 1 or any(often[q] >= a for q in longer):
                continue
            score, k = min(((1000 * a * n) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [
            (lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)
        ]
    return sorted(out)


def mined(spark, docs, **how):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, text string, n int, words int")
    return sorted(tuple(r) for r in collocations.mine(df.repartition(3), **how).collect())


DOCS = [
    ("en", "A b c d e f, a b\tc d; x\nb c  d e a b. a a a a a a"), ("en", "A B C d e! a b c d e f"), ("en", None), ("en", ""),
    (None, "é ü\x85x é ü\x85x é ü"), (None, "É ü é ü"), ("und", "é ü \x00 \x0b\x0c é ü"), ("de", " ,.;\t\n"),
    ("en", "a b c d e f g " * 40), ("en", "a b c d e f g " * 40), ("fr", "one"),
]


@pytest.mark.parametrize(("longest", "least", "top"), [(5, 2, 2000), (5, 3, 4), (3, 2, 2000), (2, 1, 2000), (7, 2, 3)])
def test_against_plain_counts(spark, monkeypatch, longest, least, top):
    monkeypatch.setattr(collocations, "BLOCK", 30)
    assert mined(spark, DOCS, longest=longest, least=least, top=top) == plain(DOCS, longest, least, top)


def test_saturated_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_holds", lambda bits, hashes: hashes == hashes)
    assert mined(spark, DOCS, least=3) == plain(DOCS, 5, 3, 2000)


def test_odd_rows(spark, odd):
    assert collocations.mine(odd.limit(0)).collect() == []
    assert {r.phrase: r.a for r in collocations.mine(odd, least=2, longest=3).collect()}["word word"] == 29_999
    with pytest.raises(ValueError):
        collocations.mine(odd, longest=1)


def test_products_beyond_64_bits(spark):
    n = 3_000_000_000_000
    exact = "cast({} as decimal(19,0))"
    row = spark.range(1).selectExpr(
        f"cast(1000 * {exact.format(n)} * {exact.format(7 * n)} as decimal(38,0)) div ({exact.format(n)} * {exact.format(n)}) as s"
    )
    assert row.first().s == 7000
