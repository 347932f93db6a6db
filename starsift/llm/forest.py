"""Near-duplicate groups by an LSH forest of MinHash signatures.

Every text becomes a set of word shingles and a signature of ``VALUES`` minimum
hashes. A tree is one order of those values; texts sorted in that order stand
next to the texts with the longest common prefix, so each is compared with its
``NEIGHBOURS`` successors in ``SORTED`` of the trees. How deep two neighbours agree
follows from how crowded their region of the order is: a few values in a sparse one,
the whole key in a crowded one. A crowded region's most typical member is also compared
with all of it, which ties copies of one original together. The likeliest pairs are
confirmed on the full shingle sets and give first groups. All this only saves work:
afterwards all texts that share a region in any of the ``TREES`` orders and are in
different groups are compared by their parity maps, a bound that no linked pair can
break and that holds for sets of any size. Of the pairs within the bound, first the
closest of each text and group are confirmed, then, with the groups that this
joined, those that still stand between groups. A region is dealt in blocks, so a
region of any size is spread over tasks, and dense groups give few rows, not all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.llm.components import components
from starsift.llm.words import WordHashes, mix, shingle_set, utf8
from starsift.operators.lookup import lookup
from starsift.session import stored

#: Minimum hashes in a signature (16 bits are kept of each).
VALUES = 128
#: Orders of the signature.
TREES = 40
#: Trees in which neighbours are compared before whole regions are; two texts of 80 % share a region of one of them in 98 %.
SORTED = 8
#: Values two texts must share at the start of an order to be in one region.
DEPTH = 4
#: Further values by which a region is sorted.
TAIL = 12
#: Of the further values, how many neighbours must share wherever they stand.
AGREE = 5
#: Successors in an order that a text is compared with.
NEIGHBOURS = 4
#: How many values of neighbours may differ in their last two bits: 3.5 deviations above 80 %.
MOST_DIFFERENT = 34
#: Bits of a set's parity map: least and most; between them at least four a shingle.
PARITY, WIDEST = 1 << 10, 1 << 16
#: About how many rows of a region one block has.
BLOCK = 1024
#: Bits of the filter that finds the documents whose sets are needed.
FILTER_BITS = 1 << 26
_SEED = 20240229
_CHUNK = 4096


def signature(shingles: np.ndarray, values: int = VALUES) -> np.ndarray:
    """Low 16 bits of ``values`` minimum hashes of a non-empty set."""
    rng = np.random.default_rng(_SEED)
    scale = (rng.integers(0, 2**32, values, dtype=np.uint32) | np.uint32(1))[:, None]
    shift = rng.integers(0, 2**32, values, dtype=np.uint32)[:, None]
    return _signature(shingles, scale, shift)


def _signature(shingles: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(scale), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(folded), _CHUNK):
        np.minimum(low, (folded[at : at + _CHUNK] * scale + shift).min(axis=1), out=low)
    return (low & np.uint32(0xFFFF)).astype(">u2")


def _parity(shingles: np.ndarray) -> bytes:
    """For each place of a map whether an odd number of shingles falls there.

    Shared shingles cancel out, so two maps differ in at most as many places as the sets in
    shingles. Widths are powers of two: halves laid over each other give the map of half the width.
    """
    width = min(max(PARITY, 1 << (4 * len(shingles) - 1).bit_length()), WIDEST)
    places = (shingles & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=width) & 1).astype(np.uint8)).tobytes()


def _narrowed(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity maps (rows of 64-bit words) at a width of ``words`` words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, number of shingles, a key of the set, its signature and its parity map."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        rng = np.random.default_rng(_SEED)
        scale = (rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1))[:, None]
        shift = rng.integers(0, 2**32, VALUES, dtype=np.uint32)[:, None]
        for batch in batches:
            out = []
            for text in batch.text:
                grams = shingle_set(hashes.of(utf8(text).lower().split()), size)
                sign = _signature(grams, scale, shift).tobytes() if len(grams) else b""
                parity = _parity(grams) if len(grams) else b""
                out.append((len(grams), xxhash.xxh3_128_digest(grams.tobytes()), sign, parity))
            frame = pd.DataFrame(out, columns=["n", "key", "sig", "parity"], index=batch.index)
            yield pd.concat([batch[["doc_id"]].astype("Int64"), frame], axis=1)

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, n long, key binary, sig binary, parity binary")


def _orders() -> list[np.ndarray]:
    rng = np.random.default_rng(_SEED + 1)
    return [rng.permutation(VALUES)[: DEPTH + TAIL] for _ in range(TREES)]


def _region(signs: np.ndarray, tree: int, order: np.ndarray) -> np.ndarray:
    head = signs[:, order[:DEPTH]].astype(np.uint64)
    region = np.full(len(signs), tree + 1, dtype=np.uint64)
    for at in range(DEPTH):
        region = mix(region * np.uint64(65537) + head[:, at])
    return region.view(np.int64)


def _trees(classes: DataFrame) -> DataFrame:
    """One row per text class and sorted tree: its region, the values that sort it, size and id.

    ``marks`` holds two bits of every value of the signature.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = _orders()[:SORTED]
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.sig), dtype=">u2").reshape(-1, VALUES)
            low = (signs & 3).astype(np.uint8).reshape(-1, VALUES // 4, 4)
            low = np.bitwise_or.reduce(low << np.array([0, 2, 4, 6], dtype=np.uint8), axis=2)
            marks = [row.tobytes() for row in low]
            for tree, order in enumerate(orders):
                tail = np.ascontiguousarray(signs[:, order[DEPTH:]]).tobytes()
                width = 2 * TAIL
                yield pd.DataFrame({
                    "marks": marks,
                    "region": _region(signs, tree, order),
                    "suffix": [tail[i : i + width] for i in range(0, len(tail), width)],
                    "id": batch.id.to_numpy(),
                    "n": batch.n.to_numpy(),
                })

    schema = "marks binary, region long, suffix binary, id long, n long"
    return classes.select("id", "n", "sig").mapInPandas(rows, schema)


def _close(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    sizes = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return sizes & ((x == y).sum(axis=1) >= AGREE)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the marks of two texts (see ``_trees``) allow for linked sets."""
    apart = x ^ y
    return np.bitwise_count((apart | (apart >> 1)) & 0x55).sum(axis=1) <= MOST_DIFFERENT


def _pairs(trees: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs from the sorted orders.

    Each row with its next ``NEIGHBOURS`` rows, and the members of a crowded region with
    the one that shares most values with the others. Only pairs whose marks agree enough
    are given. Counted are the meetings of a pair and those in which either was the typical one.
    """
    reach = NEIGHBOURS

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            if kept is not None:
                batch = pd.concat([kept, batch], ignore_index=True)
            kept = batch.iloc[-reach:]
            region, ids, n = (batch[c].to_numpy() for c in ("region", "id", "n"))
            tail = np.frombuffer(b"".join(batch.suffix), dtype=">u2").reshape(-1, TAIL)
            marks = np.frombuffer(b"".join(batch.marks), dtype=np.uint8).reshape(-1, VALUES // 4)
            # Places in the batch of the two texts of each pair.
            left, right, middles = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, dtype=bool)]
            for step in range(1, min(reach, len(ids) - 1) + 1):
                near = np.flatnonzero(region[:-step] == region[step:])
                if not len(near):
                    continue
                near = near[_close(tail[near], tail[near + step], n[near], n[near + step], percent)]
                near = near[_alike(marks[near], marks[near + step])]
                left.append(near)
                right.append(near + step)
                middles.append(np.zeros(len(near), dtype=bool))
            edges = np.flatnonzero(np.r_[True, region[1:] != region[:-1], True])
            for start, end in zip(edges[:-1], edges[1:]):
                if end - start <= 2 * reach:
                    continue
                part = tail[start:end]
                votes = np.zeros(end - start, dtype=np.int64)
                for column in part.T:
                    _, value, count = np.unique(column, return_inverse=True, return_counts=True)
                    votes += count[value]
                middle = int(np.argmax(votes))
                centre = np.broadcast_to(part[middle], part.shape)
                own = n[start:end]
                others = start + np.flatnonzero(_close(part, centre, own, np.full_like(own, own[middle]), percent))
                others = others[_alike(marks[others], marks[start + middle])]
                left.append(np.full(len(others), start + middle))
                right.append(others)
                middles.append(np.ones(len(others), dtype=bool))
            one, two, middle = np.concatenate(left), np.concatenate(right), np.concatenate(middles)
            ahead = ids[one] <= ids[two]
            low, high = np.where(ahead, one, two), np.where(ahead, two, one)
            out = pd.DataFrame({
                "a": ids[low], "b": ids[high], "met": 1,
                "by_a": (middle & ahead).astype(np.int64), "by_b": (middle & ~ahead).astype(np.int64),
            })
            yield out[out.a != out.b].groupby(["a", "b"], as_index=False).sum()

    ordered = trees.repartitionByRange("region", "suffix", "id").sortWithinPartitions("region", "suffix", "id")
    found = ordered.mapInPandas(rows, "a long, b long, met long, by_a long, by_b long")
    return found.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("met", "by_a", "by_b")])


def _places(classes: DataFrame) -> DataFrame:
    """One row per text class and tree: its region, id and group."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = _orders()
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.sig), dtype=">u2").reshape(-1, VALUES)
            for tree, order in enumerate(orders):
                yield pd.DataFrame({"region": _region(signs, tree, order), "id": batch.id, "root": batch.root})

    return classes.select("id", "root", "sig").mapInPandas(rows, "region long, id long, root long")


def _mixed(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The regions that hold several groups, with their rows, and the places in them."""
    mixed = stored(
        places.groupBy("region").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high").select("region", "rows"),
        "mixed",
    )
    spots = lookup(places, mixed, ["region"], counts=mixed, n="rows").drop("rows")
    return mixed, stored(spots, "spots")


def _between(mixed: DataFrame, spots: DataFrame, facts: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Pairs of texts of a region that are in different groups and that no bound excludes.

    In each region the rows outside its largest group meet all rows of other
    groups. Both sides are dealt into blocks by a hash of the id; a pair of
    blocks is one unit of work, so no region fills a task. A pair is left out if its sizes or
    parity maps show that the sets cannot be linked. If ``closest``, of a text's pairs with
    a group a block gives the one whose maps differ in the smallest share. ``facts``: id, n, parity.
    """
    groups = spots.groupBy("region", "root").agg(F.count("*").alias("m"))
    table = stored(
        groups.groupBy("region").agg(F.sum("m").alias("size"), F.max(F.struct("m", "root")).alias("top"))
        .select(
            "region", F.col("top.root").alias("lead"), F.ceil(F.col("size") / BLOCK).alias("targets"),
            F.ceil((F.col("size") - F.col("top.m")) / BLOCK).alias("probes"),
        ),
        "regions",
    )
    rows = lookup(spots, table, ["region"], counts=mixed, n="rows").join(facts, "id")
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 40))

    def side(df: DataFrame, own: str, other: str, probe: bool) -> DataFrame:
        return df.select(
            "region", (spot % F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other),
            F.lit(probe).alias("probe"), "id", "n", "root", "parity",
        ).select("region", "targets", "probes", "probe", "id", "n", "root", "parity")

    dealt = side(rows, "targets", "probes", False).union(side(rows.where("root <> lead"), "probes", "targets", True))
    blocks = ["region", "targets", "probes"]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            if kept is not None:
                batch = pd.concat([kept, batch], ignore_index=True)
            keys = batch[blocks].to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for start, end in zip(edges[:-2], edges[1:-1]):
                yield from met(batch.iloc[start:end])
            kept = batch.iloc[edges[-2] :]  # the last block may go on in the next batch
        if kept is not None:
            yield from met(kept)

    def met(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        probe = block.probe.to_numpy()
        if probe.all() or not probe.any():
            return
        ids, n, root = (block[c].to_numpy() for c in ("id", "n", "root"))
        own = [np.frombuffer(m, dtype=np.uint64)[None, :] for m in block.parity]
        width = np.array([m.shape[1] for m in own])
        to = np.flatnonzero(~probe)
        # (own width, compared width) -> maps of the targets of that own width, and their places in it
        tables: dict[tuple[int, int], np.ndarray] = {}
        at = np.zeros(len(ids), dtype=np.int64)
        for words in np.unique(width[to]):
            same = to[width[to] == words]
            at[same] = np.arange(len(same))
            tables[words, words] = np.concatenate([own[i] for i in same])
        for one in np.flatnonzero(probe):
            two = to[root[to] != root[one]]
            two = two[100 * np.minimum(n[two], n[one]) >= percent * np.maximum(n[two], n[one])]
            apart = np.zeros(len(two), dtype=np.int64)
            for words in np.unique(width[two]):
                least = min(words, width[one])
                if (words, least) not in tables:
                    tables[words, least] = _narrowed(tables[words, words], least)
                part = np.flatnonzero(width[two] == words)
                maps = tables[words, least][at[two[part]]] ^ _narrowed(own[one], least)
                apart[part] = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
            near = (100 + percent) * apart <= (100 - percent) * (n[two] + n[one])
            two, apart = two[near], apart[near]
            if closest and len(two):
                order = np.lexsort((ids[two], apart / (n[two] + n[one])))
                two = two[order][np.unique(root[two[order]], return_index=True)[1]]
            if len(two):
                ahead = ids[two] > ids[one]
                yield pd.DataFrame({
                    "a": np.minimum(ids[two], ids[one]), "b": np.maximum(ids[two], ids[one]),
                    "ra": np.where(ahead, root[one], root[two]), "rb": np.where(ahead, root[two], root[one]),
                })

    found = dealt.repartition(*blocks).sortWithinPartitions(*blocks).mapInPandas(pairs, "a long, b long, ra long, rb long")
    return found.distinct()


def _sets(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Whole shingle sets of the documents in ``pairs``, and of a few others.

    The ids needed set bits of a filter of ``FILTER_BITS`` bits (which bounds what is
    broadcast), so texts are neither shuffled nor joined. The more ids, the more
    others pass; a join on the id drops them.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = (
        pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(bit.alias("bit"))
        .groupBy(F.expr("shiftright(bit, 6)").alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask")).toPandas()
    )
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[words["at"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, bits = WordHashes(), shared.value.view(np.uint64)
        for batch in batches:
            at = batch.bit.to_numpy(np.int64)
            batch = batch[((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)]
            grams = [shingle_set(hashes.of(utf8(t).lower().split()), size).tobytes() for t in batch.text]
            yield pd.DataFrame({"id": batch.id, "grams": grams})

    own = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text").withColumn("bit", bit)
    return own.mapInPandas(rows, "id long, grams binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets meet ``100 * intersection >= percent * union``."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(x, y):
            one, two = np.frombuffer(one, dtype=np.uint64), np.frombuffer(two, dtype=np.uint64)
            both = len(np.intersect1d(one, two, assume_unique=True))
            out.append(bool(both) and 100 * both >= percent * (len(one) + len(two) - both))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(linked("x", "y")).select(*pairs.columns).distinct()


def _likely(pairs: DataFrame) -> DataFrame:
    """For each text the pair that met most, and the typical text with the most followers it met."""

    def sides(df: DataFrame) -> DataFrame:
        one = df.select(F.col("a").alias("id"), F.col("b").alias("other"), "met", F.col("by_b").alias("by"))
        return one.union(df.select(F.col("b").alias("id"), F.col("a").alias("other"), "met", F.col("by_a").alias("by")))

    both = sides(pairs)
    led = both.where("by > 0")
    followers = led.groupBy(F.col("other")).agg(F.count("*").alias("followers"))
    first = F.struct(F.col("met"), -F.col("other"))
    lead = F.struct(F.col("followers"), -F.col("other"))
    nearest = both.groupBy("id").agg((-F.max(first)["col2"]).alias("other"))
    leaders = led.join(followers, "other").groupBy("id").agg((-F.max(lead)["col2"]).alias("other"))
    return nearest.union(leaders).select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")
    ).distinct()


def _with_root(df: DataFrame, roots: DataFrame, name: str, out: str) -> DataFrame:
    """Column ``out``: the root of the node in column ``name``, or that node itself."""
    to = roots.select(F.col("node").alias(name), F.col("root").alias(out))
    return df.join(to, name, "left").withColumn(out, F.coalesce(out, name))


def _merged(roots: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``roots`` after joining the groups that confirmed pairs between them (``ra``, ``rb``) link."""
    links = _confirmed(pairs, sets, percent)
    tops = components(stored(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links"))
    tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = tops.select(F.col("root").alias("node"), F.col("top").alias("root"))
    return stored(moved.union(fresh).groupBy("node").agg(F.min("root").alias("root")), "roots")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets are similar.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A set holds the distinct
    ``words``-word shingles of the lower-cased (A-Z) text; a text with fewer words is
    one shingle. Two sets are linked if ``100 * intersection >= percent * union``.

    Returns one row per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id
    reachable over links), ``kept`` (it is that document). Texts without words, and
    null texts, have no shingle and are linked with nothing. Rows without a
    doc_id get the component of equal sets, or null, and are not kept as a
    group's document. Rows that share a doc_id count as one document.
    """
    rows = stored(_signatures(docs, words), "signatures")
    classes = stored(
        rows.where("n > 0 and doc_id is not null").groupBy("key")
        .agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("parity").alias("parity")),
        "classes",
    )
    likely = stored(_likely(stored(_pairs(_trees(classes), percent), "pairs")), "likely")
    roots = components(stored(_confirmed(likely, stored(_sets(docs, likely, words), "sets"), percent), "links"))
    places = _places(_with_root(classes, roots, "id", "root"))
    for closest in (True, False):
        mixed, spots = _mixed(places)
        left = stored(_between(mixed, spots, classes.select("id", "n", "parity"), percent, closest), "left")
        if left.limit(1).count() == 0:
            break  # nothing stands between groups
        roots = _merged(roots, left, stored(_sets(docs, left, words), "sets"), percent)
        places = _with_root(spots.drop("root"), roots, "id", "root")
    named = stored(_with_root(classes, roots, "id", "root").select("key", "root"), "groups")
    group = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "n", "key").join(named, "key", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"),
            F.coalesce(F.col("doc_id") == group, F.lit(False)).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one row of every group of near-duplicates stays.

    The decision is on texts, whatever ids they stand under: ids may repeat or be null. Of a group the row of
    the smallest doc_id stays, nulls last, ties in an order fixed by the text. Rows without
    words (null, empty) are in no group and all stay. Other columns are kept as they are.
    """
    row = next(name for at in range(len(docs.columns) + 1) if (name := f"_row{at}") not in docs.columns)
    # Written once, so that a row keeps its number.
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words=words, percent=percent)
    facts = rows.select(F.col(row).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    placed = groups.select(F.col("doc_id").alias("row"), "n_shingles", "component_id").join(facts, "row")
    placed = stored(placed, "placed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row")
    leads = placed.where("n_shingles > 0").groupBy("component_id").agg(F.min(order)["row"].alias(row)).select(row)
    wordless = placed.where("n_shingles = 0").select(F.col("row").alias(row))
    return rows.join(leads.union(wordless), row, "left_semi").select(*docs.columns)
