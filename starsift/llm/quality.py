"""Quality rules as learned decision lists.

Statistics of whole texts are compared with thresholds. Sequential covering
learns one rule after another: a rule grows by the threshold that gains most on
one part of the labelled rows, is pruned on the other part, and the rows it
covers are set aside. The rules become one ordered conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starsift.llm.words import WordHashes, runs, utf8

#: Labelled rows the rules may be learnt from.
MAX_ROWS = 20_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Thresholds tried per statistic, conditions of a rule, rules, and how sure a rule must be on the pruning part.
CUTS, CONDITIONS, RULES, PRECISION = 48, 3, 12, 0.95
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "bar_share", "same_word_share"]


def statistics(text: str | None, hashes: WordHashes) -> tuple:
    """Counts and shares of one text; a null text is an empty one."""
    text = text or ""
    raw = utf8(text)
    h = hashes.of(raw.split())
    n = len(h)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    grams = runs(h, WINDOW)
    if len(grams) > 1:
        _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[back] > 1)
        if len(again):
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + WINDOW, -1)
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    same = int((h[1:] == h[:-1]).sum()) if n > 1 else 0
    bytes_ = np.frombuffer(raw, dtype=np.uint8)
    upper = int(((bytes_ >= 65) & (bytes_ <= 90)).sum())
    words, size = max(n, 1), max(chars, 1)
    return (
        n, chars, symbols, dup_lines, repeat, symbols / size, dup_lines / max(len(lines), 1), repeat / words,
        upper / size, text.count("!") / size, text.count("|") / words, same / words,
    )


def profile(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with a struct of statistics of the whole text."""

    @F.pandas_udf(", ".join([f"{c} long" for c in BASE] + [f"{c} double" for c in RATIOS]))
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame([statistics(t, hashes) for t in batch], columns=BASE + RATIOS)

    return docs.withColumn(out, stats(F.col(text)))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


Rule = list[tuple[str, bool, float]]


def covers(rule: Rule, rows: pd.DataFrame) -> np.ndarray:
    """Rows that meet all conditions (statistic, at least?, threshold) of a rule."""
    out = np.ones(len(rows), dtype=bool)
    for name, above, cut in rule:
        out &= (rows[name].to_numpy() >= cut) if above else (rows[name].to_numpy() < cut)
    return out


def _grow(rows: pd.DataFrame, bad: np.ndarray) -> Rule:
    rule, inside = [], np.ones(len(rows), dtype=bool)
    for _ in range(CONDITIONS):
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        if n == 0 or p == 0:
            break
        best, gain = None, 1e-9
        for name in RATIOS + ["n_words"]:
            x = rows[name].to_numpy(dtype=float)
            for cut in np.unique(np.quantile(x[inside & bad], np.linspace(0, 1, CUTS))):
                for above in (True, False):
                    hit = inside & ((x >= cut) if above else (x < cut))
                    p1, n1 = bad[hit].sum(), (~bad[hit]).sum()
                    if p1:
                        more = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if more > gain:
                            best, gain = (name, above, float(cut)), more
        if best is None:
            break
        rule.append(best)
        inside &= covers([best], rows)
    return rule


def learn(rows: pd.DataFrame, bad: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows. Every third row is for pruning; the order of the rows decides which."""
    rules: list[Rule] = []
    prune = np.arange(len(rows)) % 3 == 2
    left = np.ones(len(rows), dtype=bool)

    def sure(rule: Rule, part: np.ndarray) -> float:
        hit = covers(rule, rows) & part
        return (bad[hit].sum() + 0.5) / (hit.sum() + 1) if hit.sum() else 0.0

    while len(rules) < RULES and (bad & left & ~prune).sum() >= 3:
        grown = left & ~prune
        rule = _grow(rows[grown], bad[grown])
        if not rule:
            break
        while len(rule) > 1 and sure(rule[:-1], left & prune) >= sure(rule, left & prune):
            rule = rule[:-1]
        if sure(rule, left & prune) < PRECISION:
            break
        rules.append(rule)
        left &= ~covers(rule, rows)
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules from the labelled rows (``labels``: doc_id, quality; 0 is bad) that pass the base rules.

    Null ids and labels are left out, a document labelled both ways counts as bad.
    The ``max_rows`` documents whose ids hash lowest are used; their
    statistics, not their texts, reach the driver.
    """
    known = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
        .agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id", "quality", "h").agg(F.min("text").alias("text"))
    table = profile(rows).where(~base_failed(F.col("stats"))).select("h", "doc_id", "quality", "stats.*").toPandas()
    table = table.sort_values(["h", "doc_id"], ignore_index=True)
    return learn(table, (table.quality == 0).to_numpy()) if len(table) else []


def verdict(rules: list[Rule], s: Column) -> Column:
    """True to keep: the first rule that holds rejects."""
    out = F
    for rule in rules:
        test = F.lit(True)
        for name, above, cut in rule:
            test = test & ((s[name] >= cut) if above else (s[name] < cut))
        out = out.when(test, F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with ``stats``, ``base_failed`` and ``kept``; texts without words fail."""
    s = F.col("stats")
    return (
        profile(docs, text).withColumn("base_failed", base_failed(s))
        .withColumn("kept", ~F.col("base_failed") & verdict(rules, s))
    )
