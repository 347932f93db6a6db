"""Best-fit packing of documents into sequences, with conflicts.

Documents are cut into pieces of at most ``capacity`` words. Pieces are dealt to
cells of bounded size by a hash; in a cell the longest come first and each goes
into the open bin with the least room that still takes it. Bins are kept in
order of their room and carry bitmaps of their sources and duplicate clusters;
the search goes on to the next roomier bin until one has neither the piece's
cluster nor as many pieces of its source as a bin may hold.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.session import stored

#: Words in a bin, pieces of one source in a bin, pieces in a cell on average.
CAPACITY, PER_SOURCE, CELL = 2048, 4, 2048


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of pieces that come longest first.

    Each bin has one bitmap per number of pieces it holds of a source, and one of clusters.
    """
    bit_of: dict = {}
    room: list[tuple[int, int]] = []  # (words left, bin), ascending
    levels: list[list[int]] = []
    held: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        own = 1 << bit_of.setdefault(("s", source), len(bit_of))
        group = 1 << bit_of.setdefault(("c", cluster), len(bit_of))
        at = bisect_left(room, (size, -1))
        while at < len(room) and (held[room[at][1]] & group or levels[room[at][1]][-1] & own):
            at += 1
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number = capacity, len(held)
            levels.append([0] * per_source)
            held.append(0)
        out.append((number, capacity - left))
        held[number] |= group
        for level in range(per_source):
            if not levels[number][level] & own:
                levels[number][level] |= own
                break
        if left > size:
            insort(room, (left - size, number))
    return out


def pack(
    docs: DataFrame,
    *,
    size: str,
    source: str = "source",
    cluster: str,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    cell: int = CELL,
) -> DataFrame:
    """Place documents of given sizes into bins.

    Returns one row per piece: ``doc_id, cluster, piece, start, size, cell, bin, offset``.
    A bin holds at most ``capacity`` words, no two pieces of one cluster but
    those of its own document's cut, and at most ``per_source`` pieces of one source. Full-size
    pieces fill a bin alone. Documents of size zero or null take no room: one row
    with null cell, bin and offset. A null source or cluster is a value like
    another. Rows repeated whole are packed as often as they occur.
    """
    own = docs.select(
        "doc_id", F.col(source).alias("source"), F.col(cluster).alias("cluster"),
        F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("length"),
    )
    # Equal rows are counted first, so that they too are dealt to different cells.
    counted = own.groupBy("doc_id", "source", "cluster", "length").agg(F.count("*").alias("copies"))
    rows = counted.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    parts = F.greatest(F.ceil(F.col("length") / F.lit(capacity)), F.lit(1))
    pieces = stored(
        rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .withColumn("start", F.col("piece") * capacity)
        .withColumn("size", F.least(F.col("length") - F.col("start"), F.lit(capacity)))
        .select("doc_id", "source", "cluster", "copy", "piece", "start", "size"),
        "pieces",
    )
    short = pieces.where((F.col("size") > 0) & (F.col("size") < capacity))
    cells = max(1, math.ceil(short.count() / cell))
    names = ["doc_id", "cluster", "piece", "start", "size"]
    out = [*names, "cell", "bin", "offset"]

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "cluster", "copy"], ascending=[False, True, True, True])
        found = best_fit(
            group["size"].tolist(), group["source"].tolist(), group["cluster"].tolist(), capacity, per_source
        )
        group["bin"] = [b for b, _ in found]
        group["offset"] = [o for _, o in found]
        return group[out].astype({"doc_id": "Int64"})

    schema = "doc_id long, cluster long, piece long, start long, size long, cell long, bin long, offset long"
    dealt = short.withColumn("cell", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(cells)))
    packed = dealt.groupBy("cell").applyInPandas(fill, schema)
    # A full piece is a bin of its own, numbered by what it is.
    full = pieces.where(F.col("size") == capacity).select(
        *names, F.lit(-1).cast("long").alias("cell"),
        F.xxhash64("doc_id", "cluster", "copy", "piece").alias("bin"), F.lit(0).cast("long").alias("offset"),
    )
    none = F.lit(None).cast("long")
    empty = pieces.where(F.col("size") <= 0).select(*names, none.alias("cell"), none.alias("bin"), none.alias("offset"))
    return packed.unionByName(full).unionByName(empty)


def word_count(text: str = "text"):
    """Words (between ASCII white space) of a whole text; null has none."""
    return F.expr(f"regexp_count(coalesce({text}, ''), '[^\\\\x20\\\\x09-\\\\x0D]+')").cast("long")


def text_cluster(text: str = "text"):
    """One value per text up to letter case and white space."""
    return F.xxhash64(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
