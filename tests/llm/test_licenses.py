"""Template labels against a plain version of the look-up."""

import math
import random
import re
from collections import Counter

from starsift.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def stands(words, phrase):
    p = phrase.split()
    return any(words[i : i + len(p)] == p for i in range(len(words) - len(p) + 1))


def plain(texts):
    """id -> {label: share} of all texts."""
    held = {k: words_of(t) for k, t in texts.items()}
    n = Counter(w for words in held.values() for w in set(words))
    idf = lambda w: math.log((len(texts) + 1) / (n[w] + 1))
    out = {}
    for k, words in held.items():
        out[k] = {}
        for label, (notice, must) in licenses.TEMPLATES.items():
            posted = notice.split()
            rare = sorted(set(posted) & set(words), key=lambda w: (-idf(w), w))[: licenses.RARE]
            shifts = Counter(
                s for w in rare
                for s in {i - j for i, x in enumerate(words) if x == w for j, y in enumerate(posted) if y == w}
            )
            agree = max(shifts.values(), default=0)
            if agree >= licenses.LEAST and agree >= licenses.AGREE * len(rare) and all(stands(words, p) for p in must):
                out[k][label] = agree / len(rare)
    return out


def compare(spark, texts):
    rows = licenses.scan(spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)).collect()
    want = plain(texts)
    for r in rows:
        base = {x for x in r.base_labels.split(",") if x}
        assert {x for x in r.labels.split(",") if x} == base | set(want[r.doc_id]), texts[r.doc_id]
        assert abs(r.score - (1.0 if r.n_base else max(want[r.doc_id].values(), default=0.0))) < 1e-12
    return {r.doc_id: r.labels for r in rows}


def test_cut_notices(spark):
    cut = {
        1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        2: "Redistribution and use in source and binary forms", 3: "Licensed under the Apache License",
        4: "This program is free software, under the terms of the GNU General Public License.",
        5: licenses.TEMPLATES["mit"][0], 6: "software of the license and source", 7: None, 8: "",
    }
    filler = {100 + i: "the and of to in is a this with any software program ordinary words" for i in range(40)}
    got = compare(spark, cut | filler)
    assert [got[i] for i in range(1, 9)] == ["mit", "bsd", "apache-2", "gpl", "mit", "", "", ""]


def test_mixed_notices(spark):
    draw, texts = random.Random(5), {}
    notices = [n for n, _ in licenses.TEMPLATES.values()]
    for i in range(150):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            w = draw.choice(notices).split()
            start = draw.randrange(len(w))
            w = w[start : start + draw.randrange(3, 40)]
            if draw.random() < 0.4:
                w[draw.randrange(len(w))] = "odd"
            parts += [*draw.choices(["x", "the", "license", "of", "é"], k=draw.randrange(6)), *w]
        texts[i] = draw.choice([" ", ", ", "\n"]).join(parts)
    texts |= {200: " ".join(["license the of"] * 4000) + " apache license " + notices[2]}
    got = compare(spark, texts)
    assert sum(bool(x) for x in got.values()) > 40
