"""Greedy longest-match subword encoding against a user-supplied vocabulary.

A vocabulary is a DataFrame (piece string, id int); a piece that continues a
word starts with ``##``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starsift.functions.text import basic_words
from starsift.operators.lookup import HOT_SHARE, lookup
from starsift.operators.numbering import numbered
from starsift.session import stored

# --- fixed values: marker pieces and limits of uncased subword models ---
PAD, UNKNOWN, START, END, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
SPECIAL_PIECES = [PAD, UNKNOWN, START, END, MASK]
MAX_WORD_CHARS = 100
# --- end of fixed values ---

#: Vocabularies up to this many pieces are sent to the tasks; larger ones are joined.
MAX_BROADCAST_PIECES = 500_000
#: Words remembered by a task; common words are then encoded once per task.
MEMO_WORDS = 200_000


def greedy_pieces(word: str, ids: dict[str, int], unknown: int) -> list[int]:
    """Ids of the longest matching pieces from left to right, or the unknown id."""
    if len(word) > MAX_WORD_CHARS:
        return [unknown]
    found, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        for end in range(len(word), at, -1):
            piece = ids.get(mark + word[at:end])
            if piece is not None:
                break
        else:
            return [unknown]
        found.append(piece)
        at = end
    return found


def _encode_in_tasks(df: DataFrame, ids: dict[str, int], words: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(ids)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        unknown = table[UNKNOWN]
        memo: dict[str, list[int]] = {}

        def pieces(word: str) -> list[int]:
            known = memo.get(word)
            if known is None:
                known = greedy_pieces(word, table, unknown)
                if len(memo) < MEMO_WORDS:
                    memo[word] = known
            return known

        for batch in batches:
            lines = [[i for w in row.split(" ") for i in pieces(w)] if row else [] for row in batch]
            yield pd.Series(lines, dtype=object)

    # Words hold no blanks; one string per row crosses to Python faster than an array.
    return df.withColumn(out, encode(F.array_join(words, " ")))


def _encode_by_join(
    df: DataFrame, vocab: DataFrame, key: str, words: str, out: str, share: int
) -> DataFrame:
    """The same ids without holding the vocabulary anywhere: each distinct word's
    substrings are joined with the vocabulary, and the walk over a word's longest
    matches happens in its row."""
    places = df.select(key, F.posexplode(words).alias("_pos", "word"))
    counts = stored(places.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    short = counts.filter(F.length("word") <= MAX_WORD_CHARS).select("word")
    parts = (
        short.select(
            "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
        )
        .select(
            "word", "at",
            F.explode(F.sequence(F.lit(1), F.length("word") - F.col("at") + 1)).alias("size"),
        )
        .select(
            "word", "at", "size",
            F.concat(
                F.when(F.col("at") > 1, "##").otherwise(""),
                F.substr("word", F.col("at"), F.col("size")),
            ).alias("piece"),
        )
    )
    best = (
        parts.join(vocab.select("piece", "id"), "piece")
        .groupBy("word", "at")
        .agg(F.max(F.struct("size", "id")).alias("best"))
        .groupBy("word")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "best"))).alias("steps"))
    )
    unknown = vocab.filter(F.col("piece") == UNKNOWN).select("id").scalar()
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))

    def step(state: Column, _: Column) -> Column:
        hit = F.try_element_at("steps", state["at"])
        return F.when(
            hit.isNotNull(),
            F.struct(
                (state["at"] + hit["size"]).cast("int").alias("at"),
                F.concat(state["ids"], F.array(hit["id"].cast("int"))).alias("ids"),
            ),
        ).otherwise(state)

    walked = F.aggregate(F.sequence(F.lit(1), F.length("word")), start, step)
    coded = (
        counts.select("word")
        .join(best, "word", "left")
        .withColumn("_walk", F.when(F.col("steps").isNotNull(), walked))
        .select(
            "word",
            F.when(F.col("_walk.at") == F.length("word") + 1, F.col("_walk.ids"))
            .otherwise(F.array(unknown.cast("int")))
            .alias("_ids"),
        )
    )
    joined = lookup(places, coded, ["word"], counts=counts, share=share)
    lines = joined.groupBy(key).agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_pos", "_ids"))), lambda s: s["_ids"]
            )
        ).alias(out)
    )
    none = F.array().cast("array<int>")
    return df.join(lines, key, "left").withColumn(out, F.coalesce(F.col(out), none))


def wordpiece_encode(
    df: DataFrame,
    vocab: DataFrame,
    *,
    text: str = "text",
    out: str = "input_ids",
    max_length: int | None = 128,
    max_broadcast: int = MAX_BROADCAST_PIECES,
    share: int = HOT_SHARE,
) -> DataFrame:
    """``df`` plus the ids of ``[CLS] pieces [SEP]``, cut to ``max_length`` ids.

    Words are split by built-in expressions. A vocabulary of checked size goes
    to the tasks, and encoding needs no shuffle; a larger one is joined, with the same
    result for every row, also where keys repeat or are null. A piece that stands twice in
    the vocabulary has its largest id.
    """
    words = basic_words(text)
    if max_length is not None:  # a word has an id at least
        words = F.slice(words, 1, max(0, max_length - 2))
    rows = df.withColumn("_words", words)
    small = vocab.limit(max_broadcast + 1).select("piece", F.col("id").cast("int").alias("id"))
    pieces = small.collect()
    if len(pieces) <= max_broadcast:
        table = {row["piece"]: row["id"] for row in sorted(pieces, key=lambda row: row["id"])}
        coded = _encode_in_tasks(rows, table, "_words", out)
        first, last = F.lit(table[START]), F.lit(table[END])
    else:
        # Written once, so that a row keeps its number; keys may repeat or be null.
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
        coded = _encode_by_join(rows, vocab, "_row", "_words", out, share).drop("_row")
        first, last = (
            vocab.filter(F.col("piece") == p).select(F.col("id").cast("int")).scalar()
            for p in (START, END)
        )
    body = F.col(out)
    if max_length is not None:
        body = F.slice(body, 1, max_length - 2)
    return coded.withColumn(out, F.concat(F.array(first), body, F.array(last))).drop("_words")


def frequency_vocabulary(
    df: DataFrame, *, text: str = "text", min_count: int = 20, max_tail: int = 4
) -> DataFrame:
    """A vocabulary from a corpus: markers, every character that stands in a word, alone and as a
    continuation, all words that occur ``min_count`` times or more, and the short ones also as continuations.

    Words are those that the encoder looks up, of any script; ids follow the pieces' order.
    """
    words = df.select(F.explode(basic_words(text)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    words = stored(words.where(F.length("piece") <= MAX_WORD_CHARS), "words")
    common = words.where(F.col("n") >= min_count).select("piece")
    characters = words.select(F.explode(F.array_distinct(F.split("piece", ""))).alias("piece")).distinct()
    tails = common.where(F.length("piece") <= max_tail).union(characters)
    pieces = common.union(characters).union(tails.select(F.concat(F.lit("##"), "piece").alias("piece"))).distinct()
    ids = numbered(pieces, [F.col("piece")], "id")
    marks = df.sparkSession.createDataFrame(
        [(p, i) for i, p in enumerate(SPECIAL_PIECES)], "piece string, id int"
    )
    return stored(marks.union(ids.select("piece", (F.col("id") + len(SPECIAL_PIECES)).cast("int"))), "pieces")
