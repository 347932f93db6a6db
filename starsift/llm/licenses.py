"""License scan by a positional index of rare words, in DataFrame functions only.

Templates are short notices. Their words are posted with the positions at which
they stand. Of the licence words that a file holds, those of highest IDF over all
documents are looked up in a template's postings. A place in the file minus a place in the
template is a shift: words that agree on a shift stand to each other as in the
template. A template labels the file if enough of the file's rare words agree and its
mandatory phrases stand in the text. A shortened notice holds fewer of the
words, so fewer are looked up and have to agree.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starsift.session import stored

# --- fixed values: phrases of the base scan ---
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# --- end of fixed values ---

# --- fixed values: customary wording of licence notices, with phrases that must stand ---
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction",
        ["permission is hereby granted free of charge"],
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except"
        " in compliance with the license you may obtain a copy of the license at",
        ["apache license"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    "gpl-3": ("licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the"
        " gnu general public license as published by the free software foundation",
        ["gnu general public license"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without"
        " fee is hereby granted",
        ["permission to use copy modify"],
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license"],
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ["unencumbered software released into the public domain"],
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ["creative commons attribution sharealike"],
    ),
}
# --- end of fixed values ---

#: Rare words of a file that are looked up in a template, the least number and share of them that must agree on a shift.
RARE, LEAST, AGREE = 8, 3, 0.5
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """Words of a text, A-Z folded, each between blanks of its own."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.regexp_replace(folded, _NOT_WORD, "  "), F.lit(" "))


def _apart(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def _count(spaced_text: Column) -> Column:
    return F.regexp_count(spaced_text, F.lit("[^ ]+")).cast("long")


def _places(s: Column, phrase: str) -> Column:
    """First and last start and number of places of a phrase; phrases do not overlap themselves."""
    parts = F.split(s, re.escape(_apart(phrase)), -1)
    last = _count(s) - _count(F.element_at(parts, -1)) - len(phrase.split())
    found = F.struct(
        (F.size(parts) - 1).cast("long").alias("n"), _count(F.element_at(parts, 1)).alias("first"),
        last.cast("long").alias("last"),
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"),
                    F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(s, F.lit(_apart(phrase))), found).otherwise(none)


def _agreeing(shifts: Column) -> Column:
    """Most words that agree on a shift, of a sorted array with each word's distinct shifts."""

    def reached(k: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(shifts) - k + 1)
        same = F.exists(starts, lambda i: F.element_at(shifts, i) == F.element_at(shifts, (i + k - 1).cast("int")))
        return F.when(F.size(shifts) < k, 0).when(same, k).otherwise(0)

    return F.array_max(F.transform(F.sequence(F.lit(1), F.lit(RARE)), reached))


def _looked_up(spots: Column, known: Column, notice: str, idf: dict[str, float]) -> Column:
    """(of, agree): the file's rarest words of a template, and how many agree on a shift."""
    words = notice.split()
    places = {w: [at for at, x in enumerate(words) if x == w] for w in words}
    rarest_first = sorted(places, key=lambda w: (-idf[w], w))
    rare = F.slice(F.array_intersect(F.array(*[F.lit(w) for w in rarest_first]), known), 1, RARE)
    posted = F.create_map(*[x for w, at in places.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in at]))])

    def of_word(word: Column) -> Column:
        own = F.filter(spots, lambda spot: spot["word"] == word)
        return F.array_distinct(F.flatten(F.transform(
            own, lambda spot: F.transform(F.element_at(posted, word), lambda place: spot["at"] - place)
        )))

    shifts = F.array_sort(F.flatten(F.transform(rare, of_word)))
    # Bound as a lambda's argument, the shifts are found once.
    agree = F.element_at(F.transform(F.array(shifts), _agreeing), 1)
    return F.struct(F.size(rare).alias("of"), agree.alias("agree"))


def scan(docs: DataFrame, phrases: dict | None = None, templates: dict | None = None) -> DataFrame:
    """Licence labels of whole texts.

    Returns a row per row: ``doc_id, n_words, n_base`` (places of all base
    phrases)``, first_word, last_word`` (their smallest and largest start, else
    null)``, base_labels, labels`` (sorted, comma-joined, else empty)``, score``: 1 with a
    base phrase, else the largest share of looked-up words that agree in a template that
    labels the text, else 0. Null and empty texts have no words. Repeated rows are labelled each for
    itself, very long texts whole. Nothing is shuffled: the words of a text are found once, and only
    texts that hold a template's mandatory phrases keep the places of licence words. The tables of
    phrases and templates bound what reaches the driver and the tasks.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    vocabulary = sorted({w for notice, _ in templates.values() for w in notice.split()})
    listed = F.array(*[F.lit(w) for w in vocabulary])
    base = docs.select("doc_id", spaced(F.col("text")).alias("s"))
    holds = {
        label: reduce(lambda a, b: a & b, [F.contains("s", F.lit(_apart(p))) for p in must], F.lit(True))
        for label, (_, must) in templates.items()
    }
    likely = F.filter(F.array(*[F.when(cond, F.lit(label)) for label, cond in holds.items()]), lambda x: x.isNotNull())

    def facts(words: Column) -> Column:
        spots = F.filter(
            F.transform(words, lambda word, at: F.struct(at.alias("at"), word.alias("word"))),
            lambda spot: F.array_contains(listed, spot["word"]),
        )
        none = F.array().cast("array<struct<at:int,word:string>>")
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.array_intersect(words, listed).alias("known"),
            F.when(F.size(likely) > 0, spots).otherwise(none).alias("spots"),
        )

    words = F.filter(F.split(F.trim("s"), " +"), lambda w: w != "")
    found = base.select(
        "doc_id", F.element_at(F.transform(F.array(words), facts), 1).alias("f"), likely.alias("likely"),
        *[_places(F.col("s"), phrase).alias(f"p{at}") for at, phrase in enumerate(phrases.values())],
    )
    places = [F.col(f"p{at}") for at in range(len(phrases))]
    labels = F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(p["n"] > 0, F.lit(label)) for p, label in zip(places, phrases)]), lambda x: x.isNotNull()
    )))
    found = stored(
        found.select(
            "doc_id", "f.*", "likely", sum((p["n"] for p in places[1:]), places[0]["n"]).alias("n_base"),
            F.least(*[p["first"] for p in places]).alias("first_word"),
            F.greatest(*[p["last"] for p in places]).alias("last_word"), labels.alias("base"),
        ),
        "licences",
    )
    # IDF over all documents, of the templates' words alone.
    n_docs = found.count()
    df = {r.word: r.n for r in found.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for w in vocabulary}

    def matched(label: str, notice: str) -> Column:
        def judged(met: Column) -> Column:
            enough = (met["agree"] >= LEAST) & (met["agree"] >= met["of"] * AGREE)
            return F.when(enough, F.struct(F.lit(label).alias("label"), (met["agree"] / met["of"]).alias("share")))

        # Looked up once for a text that holds the template's mandatory phrases.
        met = F.transform(F.array(_looked_up(F.col("spots"), F.col("known"), notice, idf)), judged)
        return F.when(F.array_contains("likely", F.lit(label)), F.element_at(met, 1))

    more = F.filter(F.array(*[matched(label, notice) for label, (notice, _) in templates.items()]), lambda m: m.isNotNull())
    none = F.array().cast("array<struct<label:string,share:double>>")
    return (
        found.withColumn("more", F.when(F.size("likely") > 0, more).otherwise(none))
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word",
            F.concat_ws(",", "base").alias("base_labels"),
            F.concat_ws(",", F.array_sort(F.array_union("base", F.col("more.label")))).alias("labels"),
            F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("more.share"), F.lit(0.0))).alias("score"),
        )
    )
