"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of one to ``DEPTH`` words. Counts of context and next word
are taken over all training texts, level by level, for contexts that occur often
enough. A context is retained if its next words diverge from those of its
shorter suffix. A retained state gives its discounted counts and passes the
rest to its suffix; the last is the unigram distribution of all words. A word is
scored by the longest suffix state of what precedes it.

All states and steps are kept, in tables that grow with the texts. The logarithm of
a word's chance is a sum of what the sequences that end in it add: as a step, its
gain over its suffix, and as the context before the word, the share it passes on.
So a text's score is a sum over its sequences: tasks look up the commonest ones, the
others are joined. Sequences are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starsift.llm.collocations import _holds as holds, bitmap
from starsift.llm.words import GOLDEN, hashes_at, mix, utf8, words_at
from starsift.session import shuffles_freed, stored

DEPTH = 2
#: Sizes of what tasks look up, words and longer sequences of each length; the rest is joined.
MAX_WORDS, MAX_STEPS = 1 << 17, 1 << 18
#: Least occurrences of a context and of a transition, discount, least divergence (nats, all occurrences).
MIN_CONTEXT, MIN_STEP, DISCOUNT, DIVERGENCE = 16, 3, 0.75, 10.0
#: Tokens counted at a time, and cut into words at a time.
BLOCK, PART = 2_000_000, 250_000
_END = b"\xff"  # in no UTF-8 text


def gram(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a sequence from those of all but its last and all but its first word."""
    return mix(mix(first) * GOLDEN + last)


@dataclass
class Slots:
    """Sequences of one length by hash: each stands in the first free slot from its own on, the first given first."""

    keys: np.ndarray  # 0 where a slot is free
    gain: np.ndarray  # logarithm, as a step
    back: np.ndarray  # logarithm, as a context
    reach: int  # most slots to look at

    @classmethod
    def of(cls, code: np.ndarray, gain: np.ndarray, back: np.ndarray) -> Slots:
        size = 1 << max(2 * len(code) - 1, 1).bit_length()
        held = np.full(size, -1, dtype=np.int64)
        at, left, reach = cls.own(code, size), np.flatnonzero(code), 0
        while len(left):
            free = left[held[at[left]] < 0][::-1]
            held[at[free]] = free
            left = left[held[at[left]] != left]
            at[left] = (at[left] + 1) & (size - 1)
            reach += 1
        used = np.flatnonzero(held >= 0)
        out = cls(np.zeros(size, dtype=np.uint64), np.zeros(size), np.zeros(size), reach)
        for column, values in ((out.keys, code), (out.gain, gain), (out.back, back)):
            column[used] = values[held[used]]
        return out

    @staticmethod
    def own(code: np.ndarray, size: int) -> np.ndarray:
        return (code >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each sequence, and whether it is there."""
        at = self.own(code, len(self.keys))
        key = self.keys[at]
        hit = (key == code) & (key != 0)
        left = np.flatnonzero(~hit & (key != 0))
        for _ in range(1, self.reach):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            key = self.keys[at[left]]
            found = key == code[left]
            hit[left[found]] = True
            left = left[~found & (key != 0)]
        return at, hit


@dataclass
class Level:
    """Contexts of one word among the commonest words, by place, and the share passed to the suffix."""

    contexts: np.ndarray
    back: np.ndarray


@dataclass
class Tree:
    """What tasks hold of the model, and the tables of all of it."""

    words: np.ndarray  # xxh3 of the commonest words, ascending
    rank: np.ndarray  # their place by count
    counts: np.ndarray  # by place
    codes: np.ndarray  # hashes, by place
    total: int
    distinct: int
    levels: list[Level] = field(default_factory=list)
    slots: list[Slots] = field(default_factory=list)  # of sequences of one word, two, ...
    bits: list[np.ndarray] = field(default_factory=list)  # hashes of all sequences of two words, three, ...
    #: (code, n, more): all words with their counts, all longer sequences, and what they add to a score (log10).
    values: DataFrame | None = None

    def __getstate__(self):
        return {**self.__dict__, "values": None}

    def place(self, word_hash: int) -> int:
        """Place of a common word by the xxh3 of its bytes; -1 for others."""
        at = int(np.searchsorted(self.words, np.uint64(word_hash)))
        return int(self.rank[at]) if at < len(self.words) and self.words[at] == word_hash else -1

    def unigram(self, places: np.ndarray) -> np.ndarray:
        """Add-one probability of common words; 1 for rare ones."""
        if not len(self.counts):
            return np.ones(len(places))
        p = (self.counts[np.maximum(places, 0)] + 1.0) / (self.total + self.distinct + 1.0)
        return np.where(places >= 0, p, 1.0)

    def chances(self, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of each common word given what precedes it in its text (from ``starts``), as far as tasks hold it."""
        code = np.where(places >= 0, self.codes[places], np.uint64(0)) if len(self.codes) else np.zeros(len(places), dtype=np.uint64)
        return np.exp(self.logs(code, starts)[1])

    def logs(self, code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Logarithms of the unigram and the tree's chance, known words, and (ends, hashes) of what is not held."""
        before = np.arange(len(code)) - starts
        base = np.full(len(code), -np.log(self.total + self.distinct + 1.0))
        out, known, missing = base.copy(), np.zeros(len(code), dtype=bool), []
        for length, slots in enumerate(self.slots, 1):
            if length > 1:
                code = np.concatenate([code[:1], gram(code[:-1], code[1:])])
            whole = before >= length - 1
            at, hit = slots.find(code)
            hit &= whole
            gain = np.where(hit, slots.gain[at], 0.0)
            out += gain
            # A sequence in the middle of its text is the context of the next word.
            out[1:] += np.where(hit[:-1] & (before[1:] >= length), slots.back[at[:-1]], 0.0)
            rest = whole & ~hit
            if length == 1:
                base += gain
                known = hit
            else:
                rest &= holds(self.bits[length - 2], code)
            rest = np.flatnonzero(rest)
            missing.append((rest, code[rest]))
        return base, out, known, missing


def training(doc_id: str = "doc_id", parts: int = 7, part: int = 2):
    """Whether a row is for training; a null id is."""
    rest = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))
    return F.coalesce(rest != part, F.lit(True))


class _Part:
    """Words of some texts, each text followed by an end that no text holds."""

    def __init__(self, texts: list[str | None]):
        self.data, self.start, self.size = words_at(b" \xff ".join([*map(utf8, texts), b""]))
        self.code = hashes_at(self.data, self.start, self.size)
        ends = np.flatnonzero(np.frombuffer(self.data, dtype=np.uint8)[self.start] == 255)
        self.first = np.concatenate([[0], ends[:-1] + 1])
        self.tokens = ends - self.first + 1

    def names(self, at: np.ndarray) -> np.ndarray:
        words = (self.data[s:e] for s, e in zip(self.start[at].tolist(), (self.start[at] + self.size[at]).tolist()))
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(at))


def _ranges(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PART`` tokens, of six characters each."""
    begin, size = 0, 0
    for at, text in enumerate(texts, 1):
        size += len(text or "") // 6 + 1
        if size >= PART or at == len(texts):
            yield begin, at
            begin, size = at, 0


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[_Part]:
    for batch in batches:
        texts = batch.text.tolist()
        for begin, end in _ranges(texts):
            yield _Part(texts[begin:end])


def _blocks(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays laid together until the first holds ``BLOCK`` values."""
    held, size = [], 0
    for one in found:
        held.append(one)
        size += len(one[0])
        if size >= BLOCK:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])


def _runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of every distinct value, and how often it occurs."""
    order = np.argsort(code)
    first = _firsts(code[order])
    return order[first], np.diff(np.append(first, len(code)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word hash, xxh3 of its bytes, n) of all tokens, each text's end included; summed per block first."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
        for part in _parts(batches):
            at, n = _runs(part.code)
            yield part.code[at], part.names(at), n

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for word, name, n in _blocks(words(batches)):
            order = np.argsort(word)
            first = _firsts(word[order])
            at, n = order[first], np.add.reduceat(n[order], first)
            yield pd.DataFrame({"word": word[at].view(np.int64), "name": name[at].view(np.int64), "n": n})

    counted = texts.mapInPandas(count, "word long, name long, n long")
    return counted.groupBy("word").agg(F.min("name").alias("name"), F.sum("n").alias("n"))


def _cut(df: DataFrame, column: str, most: int) -> float:
    """Least value of a column such that at most ``most`` rows reach it, to one part in 64.

    Values are counted by their leading bits, so few rows come to the driver.
    """
    exponent = F.floor(F.log2(F.col(column).cast("double"))) - 6
    low = F.floor(F.col(column) / F.pow(F.lit(2.0), exponent)) * F.pow(F.lit(2.0), exponent)
    bins = df.where(F.col(column) > 0).groupBy(low.alias("low")).agg(F.count("*").alias("n")).collect()
    cut, rows = float("inf"), 0
    for r in sorted(bins, key=lambda r: -r.low):
        rows += r.n
        if rows > most:
            break
        cut = float(r.low)
    return cut


def _step_counts(texts: DataFrame, opened, nexts, depth: int, hot: list[int]) -> DataFrame:
    """(a, b, n): sequences of ``depth + 1`` words by all but the last and all but the first.

    Only of contexts and last words in the bitmaps, which let some others pass. Rows of a context are
    dealt together, as they then pack well; those of hot contexts over more tasks.
    """

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
        for part in _parts(batches):
            code = part.code
            for _ in range(1, depth):
                code = gram(code[:-1], code[1:])
            # A sequence stands by its first word here; it must not go on after an end.
            after = np.repeat(part.first + part.tokens, part.tokens)[: max(len(code) - 1, 0)]
            inside = np.arange(len(after)) + depth < after
            inside &= holds(opened.value, code[:-1]) & holds(nexts.value, code[1:])
            yield code[:-1][inside], code[1:][inside]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for a, b in _blocks(sequences(batches)):
            at, n = _runs(gram(a, b))
            at, n = (x[np.argsort(a[at])] for x in (at, n))
            yield pd.DataFrame({"a": a[at].view(np.int64), "b": b[at].view(np.int64), "n": n})

    found = texts.mapInPandas(count, "a long, b long, n long")
    found = found.withColumn("part", F.when(F.col("a").isin(hot), F.col("b").bitwiseAND(F.lit(15))).otherwise(F.lit(0)))
    return found.repartition("a", "part").groupBy("a", "part", "b").agg(F.sum("n").alias("n")).drop("part")


@F.pandas_udf(T.LongType())
def _gram(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(gram(a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def _hot(values: DataFrame, most: int) -> Slots:
    """The commonest of (code, n, gain, back)."""
    rows = values.where(F.col("n") >= _cut(values, "n", most)).toPandas()
    rows = rows.sort_values(["n", "code"], ascending=[False, True])
    return Slots.of(rows.code.to_numpy(np.int64).view(np.uint64), rows.gain.to_numpy(), rows.back.to_numpy())


def grow(texts: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The tree of training texts (column ``text``; null ones consist of the end) and the exact counts of all words."""
    with shuffles_freed(texts.sparkSession):
        return _grown(texts, depth)


def _grown(texts: DataFrame, depth: int) -> tuple[Tree, DataFrame]:
    sc = texts.sparkSession.sparkContext
    counts = stored(word_counts(texts), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    common = counts.where(F.col("n") >= _cut(counts, "n", MAX_WORDS)).toPandas()
    common = common.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    name, word = (common[c].to_numpy(np.int64).view(np.uint64) for c in ("name", "word"))
    by_name = np.argsort(name)
    tree = Tree(name[by_name], by_name, common.n.to_numpy(np.int64), word, int(sums.total), int(sums.distinct))
    # Sequences of one length: code, n, logarithm of the last word's chance after the others, gain over the suffix.
    own = F.log(F.col("n") + 1.0)
    grams = counts.select(
        F.col("word").alias("code"), "n", (own - F.log(F.lit(tree.total + tree.distinct + 1.0))).alias("chance"), own.alias("gain")
    )
    values = []
    for level in range(1, depth + 1):
        opened = sc.broadcast(bitmap(grams.where(F.col("n") >= MIN_CONTEXT).select(F.col("code").alias("hash"))))
        nexts = sc.broadcast(bitmap(grams.where(F.col("n") >= MIN_STEP).select(F.col("code").alias("hash"))))
        hot = grams.where(F.col("n") >= max(tree.total / 1000, MIN_CONTEXT)).select("code").collect()
        steps = stored(
            _step_counts(texts, opened, nexts, level, [r.code for r in hot]).where(F.col("n") >= MIN_STEP)
            .join(grams.where(F.col("n") >= MIN_CONTEXT).select(F.col("code").alias("a"), F.col("n").alias("occurs")), "a")
            .join(grams.select(F.col("code").alias("b"), F.col("chance").alias("suffix")), "b"),
            "steps",
        )
        opened.unpersist()
        nexts.unpersist()
        states = (
            steps.groupBy("a").agg(
                F.sum(F.col("n") * (F.log(F.col("n") / F.col("occurs")) - F.col("suffix"))).alias("divergence"),
                F.first("occurs").alias("occurs"), F.sum(F.col("n") - DISCOUNT).alias("held"),
            )
            .where(F.col("divergence") >= DIVERGENCE)
            .select("a", F.log(1 - F.col("held") / F.col("occurs")).alias("back"))
        )
        states = stored(states, "states")
        known = grams.join(states.withColumnRenamed("a", "code"), "code", "left")
        known = known.select("code", "n", "gain", F.coalesce("back", F.lit(0.0)).alias("back"))
        values.append(stored(known if level == 1 else known.where("gain <> 0 or back <> 0"), "values"))
        backed = F.col("back") + F.col("suffix")
        after = F.log((F.col("n") - DISCOUNT) / F.col("occurs") + F.exp(backed))
        grams = stored(
            steps.join(states, "a", "left").select(
                _gram("a", "b").alias("code"), "n", F.coalesce(after, "suffix").alias("chance"),
                F.coalesce(after - backed, F.lit(0.0)).alias("gain"),
            ),
            "grams",
        )
    values.append(grams.where("gain <> 0").select("code", "n", "gain", F.lit(0.0).alias("back")))
    tree.slots = [_hot(v, MAX_STEPS if length else MAX_WORDS) for length, v in enumerate(values)]
    tree.bits = [bitmap(v.select(F.col("code").alias("hash"))) for v in values[1:]]
    if len(tree.codes):
        at, hit = tree.slots[0].find(tree.codes)
        back = np.where(hit, tree.slots[0].back[at], 0.0)
        contexts = np.flatnonzero(back)
        tree.levels.append(Level(contexts, np.exp(back[contexts])))
    more = ((F.col("gain") + F.col("back")) / F.log(F.lit(10.0))).alias("more")
    tree.values = values[0].select("code", "n", more)
    for v in values[1:]:
        tree.values = tree.values.unionByName(v.select("code", F.lit(None).cast("long").alias("n"), more))
    return tree, counts


def score(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """Base and tree scores of whole texts, of any length.

    Returns a row per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).
    Null and empty texts consist of the end only. Rows with a null id count as
    training rows. Without any training text every token is unknown. ``counts`` are not read: ``tree.values`` holds them.

    Nothing is written: what the tasks do not hold goes into the join as it is found, and each text's own row with it.
    Rows are known by their places in the scan, which ``docs`` has to repeat if a task is lost.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    given = docs.select("doc_id", "text")
    out = T.StructType([given.schema["doc_id"]]).add("row", "long").add("n_tokens", "long").add("n_known", "long")
    out = out.add("base", "double").add("score", "double").add("rest", T.ArrayType(T.LongType()))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _ranges(texts):
                block = _Part(texts[begin:end])
                base, own, known, missing = tree.logs(block.code, np.repeat(block.first, block.tokens))
                at, code = (np.concatenate(x) for x in zip(*missing))
                code = code[np.argsort(at, kind="stable")].view(np.int64)
                places = np.searchsorted(np.sort(at), np.append(block.first, len(base)))
                # Each list begins with the row's number, which spreads the texts' own rows over the join.
                number = np.arange(row, row + end - begin)
                code = np.insert(code, places[:-1], number)
                places = (places + np.arange(len(places))).astype(np.int32)
                columns = [number, block.tokens, np.add.reduceat(known.astype(np.int64), block.first)]
                columns += [np.add.reduceat(x, block.first) / np.log(10.0) for x in (base, own)]
                row += end - begin
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), *map(pa.array, columns),
                     pa.ListArray.from_arrays(pa.array(places), pa.array(code))],
                    names=out.names,
                )

    rows = given.mapInArrow(scored, out)
    own = F.struct("doc_id", "n_tokens", "n_known", "base", "score")
    found = rows.select("row", own.alias("own"), F.posexplode("rest").alias("at", "code"))
    found = found.select("row", "code", F.when(F.col("at") == 0, F.col("own")).alias("own"))
    rest = F.col("own").isNull()
    sums = found.join(tree.values, "code", "left").groupBy("row").agg(
        *(F.max(f"own.{c}").alias(c) for c in ("doc_id", "n_tokens", "n_known", "base", "score")),
        F.sum(F.when(rest, F.log10(F.col("n") + 1))).alias("words"), F.sum(F.when(rest, F.col("more"))).alias("more"),
        F.count(F.when(rest, F.col("n"))).alias("more_known"),
    )
    return sums.select(
        "doc_id", (~training()).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("words", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
