"""Phrase collocations from a weighted de Bruijn graph.

A piece of a text is a walk: nodes are sequences of ``longest - 1`` words, an edge
is a window of ``longest`` words and joins the two nodes that overlap in it. Equal
edges are added up to weights. A window that a piece's end clips has no edge; it
is kept as a correction of its own. The count of any shorter phrase is then the
flow out of it, that is the weights of all edges it begins, plus the corrections it
begins. A phrase whose whole flow goes on along one edge lies inside a unary path;
compaction merges it into the longer phrase.

A walk is also cut between two words that stand together too rarely: no phrase of
enough occurrences goes across such a place. Where, is looked up in a bitmap
of the hashes of frequent words and pairs. It may let rare ones pass, which only
costs time, and never stops a frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starsift.llm.words import GOLDEN, WordHashes, mix, utf8
from starsift.operators.lookup import lookup
from starsift.session import stored

# --- fixed values: folding, separators of words and pieces (0xFF is in no UTF-8 text) ---
_END = b"\xff"
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10
)
# --- end of fixed values ---
#: Tokens counted at a time, and words remembered between blocks.
BLOCK = 500_000
#: Bits of the bitmap for each frequent word or pair, least and most bits (2 ** 27 are 16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27
#: Bits of one row of Spark's bitmap aggregate.
_ROW_BITS = 32_768
_WORD, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z folded; a single 0xFF stands between pieces and after the last."""
    return [*utf8(text).translate(_FOLD).replace(_END, b" \xff ").split(), _END]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


class _Block:
    """Tokens of some texts as places in a list of words; place 0 is the end of a piece."""

    def __init__(self, groups: list[str], texts: list[np.ndarray], ids: dict, hashes: WordHashes):
        self.words = list(ids)
        self.ids = np.concatenate(texts)
        self.groups, index = np.unique(np.array(groups, dtype=object), return_inverse=True)
        self.group = np.repeat(index, [len(t) for t in texts])
        seeds = np.array([xxhash.xxh3_64_intdigest(utf8(g)) for g in self.groups], dtype=np.uint64)
        own = mix(hashes.of(self.words)[self.ids] + mix(seeds)[self.group])
        self.word_hash = mix(own ^ _WORD)
        self.pair_hash = mix(mix(own[:-1] * GOLDEN ^ _PAIR) + own[1:])
        # A text ends with an end, so no pair goes across texts.
        self.pairs = (self.ids[:-1] > 0) & (self.ids[1:] > 0)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[_Block]:
    hashes = WordHashes()
    groups, texts, ids, size = [], [], _Ids({_END: 0}), 0
    for batch in batches:
        for group, text in zip(batch.group, batch.text):
            words = tokens(text)
            texts.append(np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)))
            groups.append(group)
            size += len(words)
            if size >= BLOCK:
                yield _Block(groups, texts, ids, hashes)
                groups, texts, ids, size = [], [], _Ids({_END: 0}), 0
    if texts:
        yield _Block(groups, texts, ids, hashes)


def frequent(texts: DataFrame, least: int) -> DataFrame:
    """(hash) of the words and pairs of neighbours that occur ``least`` times or more in a group."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            found = np.concatenate([block.word_hash[block.ids > 0], block.pair_hash[block.pairs]])
            value, n = np.unique(found, return_counts=True)
            yield pd.DataFrame({"hash": value.view(np.int64), "n": n})

    counted = texts.mapInPandas(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("hash")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes, a power of two of them between ``LEAST_BITS`` and ``MOST_BITS``."""
    wanted = hashes.count() * BITS_EACH
    bits = min(max(LEAST_BITS, 1 << max(wanted - 1, 1).bit_length()), MOST_BITS)
    place = (F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1).alias("place")
    rows = (
        hashes.select(place)
        .groupBy(F.bitmap_bucket_number("place").alias("row"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    width = _ROW_BITS // 8
    for r in rows.collect():  # at most MOST_BITS / 32768 rows
        out[(r.row - 1) * width : r.row * width] = np.frombuffer(r.map, dtype=np.uint8)
    return out


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _windows(block: _Block, bits: np.ndarray, longest: int) -> pd.DataFrame:
    """Distinct windows of a block with their counts; clipped ones hold fewer words, and none stands for all words."""
    ids = np.concatenate([block.ids, np.zeros(longest, dtype=np.int64)])
    together = np.zeros(len(ids), dtype=bool)
    together[np.flatnonzero(block.pairs)] = _holds(bits, block.pair_hash[block.pairs])
    start = np.flatnonzero((block.ids > 0) & _holds(bits, block.word_hash))
    group = block.group[start]
    rows = np.zeros((longest, len(start)), dtype=np.int64)
    rows[0] = ids[start]
    key = mix(rows[0].astype(np.uint64) * GOLDEN + group.astype(np.uint64))
    alive = np.ones(len(start), dtype=bool)
    for k in range(1, longest):
        alive = alive & together[start + k - 1]
        rows[k] = np.where(alive, ids[start + k], 0)
        key = mix(key * GOLDEN + rows[k].astype(np.uint64))
    _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    same = first[inverse]
    if not ((rows == rows[:, same]).all() and (group == group[same]).all()):  # a collision of hashes
        both = np.vstack([rows, group])
        _, first, n = np.unique(both, axis=1, return_index=True, return_counts=True)
    words = np.array([w.decode("utf-8", "surrogatepass") if at else "" for at, w in enumerate(block.words)], dtype=object)
    chosen = rows[:, first]
    length = (chosen > 0).sum(axis=0)
    phrase = words[chosen[0]]
    for k in range(1, longest):
        more = length > k
        phrase[more] = phrase[more] + " " + words[chosen[k][more]]
    totals = np.bincount(block.group[block.ids > 0], minlength=len(block.groups))
    return pd.DataFrame({
        "group": np.concatenate([block.groups[group[first]], block.groups]),
        "phrase": np.concatenate([phrase, np.full(len(totals), "", dtype=object)]),
        "words": np.concatenate([length, np.zeros(len(totals), dtype=np.int64)]),
        "n": np.concatenate([n, totals]),
    })


def edges(texts: DataFrame, bits: np.ndarray, longest: int) -> DataFrame:
    """(group, phrase, words, n): weights of the edges and, with fewer words, of clipped windows.

    The empty phrase has the number of all words of the group.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            yield _windows(block, shared.value, longest)

    return (
        texts.mapInPandas(cut, "group string, phrase string, words int, n long")
        .groupBy("group", "phrase", "words").agg(F.sum("n").alias("n"))
    )


def _part(words: Column) -> Column:
    """The first so many words of the phrase, or the last if negative."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), words.cast("int"))


def flows(graph: DataFrame, longest: int) -> DataFrame:
    """(group, phrase, words, f): occurrences of every phrase of up to ``longest`` words that begins a window."""
    starts = F.explode(F.sequence(F.lit(1), F.col("words")))
    return (
        graph.where("words > 0").select("group", "phrase", "n", starts.alias("words"))
        .select("group", _part(F.col("words")).alias("phrase"), "words", "n")
        .groupBy("group", "phrase", "words").agg(F.sum("n").alias("f"))
    )


def compact(counted: DataFrame) -> DataFrame:
    """Phrases without those inside a unary path: the whole flow goes on to one more word, before or behind.

    One step is enough, for along a path all phrases have the same flow.
    """
    inside = counted.where("words > 1").select(
        "group", "f",
        F.explode(F.array(
            _part(F.col("words") - 1), _part(1 - F.col("words"))
        )).alias("phrase"),
    ).groupBy("group", "phrase").agg(F.max("f").alias("onward"))
    return (
        counted.join(inside, ["group", "phrase"], "left")
        .where(F.col("onward").isNull() | (F.col("onward") < F.col("f"))).drop("onward")
    )


def mine(
    docs: DataFrame, text: str = "text", group: str = "lang", *, longest: int = 5, least: int = 100, top: int = 2000,
    scale: int = 1000, unknown: str = "und",
) -> DataFrame:
    """Each group's ``top`` phrases of 2 to ``longest`` words with ``least`` occurrences or more.

    Returns ``group`` (under the column's own name), ``rank`` (from 1), ``phrase``, its occurrences
    ``a``, those of the two parts of its lowest-scoring cut, ``l`` and ``r``, all words of the group ``n``,
    and ``score = floor(scale * a * n / (l * r))``, computed as decimals of 38 digits.
    Ties go to the larger ``a``, then to the smaller phrase in UTF-8. Phrases inside a
    longer one of as many occurrences are left out.

    Null groups count as ``unknown``. Null and empty texts have no words; repeated
    rows count each time; very long texts are read whole. No rows give no phrases. Other columns
    are not read.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur at least once")
    texts = docs.select(F.coalesce(group, F.lit(unknown)).alias("group"), F.col(text).alias("text"))
    bits = bitmap(stored(frequent(texts, least), "frequent"))
    graph = stored(edges(texts, bits, longest), "edges")
    counted = stored(flows(graph, longest).where(F.col("f") >= least), "flows")
    totals = stored(graph.where("words = 0").select("group", "n"), "totals")
    candidates = compact(counted).where("words > 1").withColumnRenamed("f", "a")
    # Both parts of every cut are looked up; a common word is a part of many phrases.
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    parts = stored(
        candidates.select("group", "phrase", "a", "words", cut.alias("k")).select(
            "group", "phrase", "a", "k",
            F.explode(F.array(
                F.struct(F.lit(True).alias("left"), _part(F.col("k")).alias("part")),
                F.struct(F.lit(False).alias("left"),
                         _part(F.col("k") - F.col("words")).alias("part")),
            )).alias("s"),
        ).select("group", "phrase", "a", "k", "s.*"),
        "parts",
    )
    times = stored(parts.groupBy("group", "part").agg(F.count("*").alias("n")), "times")
    sides = lookup(parts, counted.select("group", F.col("phrase").alias("part"), "f"), ["group", "part"], counts=times)
    cuts = sides.groupBy("group", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    cuts = lookup(cuts, totals, ["group"], counts=totals)
    exact = {c: f"cast({c} as decimal(19,0))" for c in "anlr"}
    score = F.expr(f"cast({scale} * {exact['a']} * {exact['n']} as decimal(38,0)) div ({exact['l']} * {exact['r']})")
    lowest = cuts.groupBy("group", "phrase", "a", "n").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    )
    order = Window.partitionBy("group").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (
        lowest.select("group", "phrase", "a", "low.l", "low.r", "n", "low.score")
        .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        .select(F.col("group").alias(group), "rank", "phrase", "a", "l", "r", "n", "score")
    )

