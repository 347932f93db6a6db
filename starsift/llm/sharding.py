"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups go, largest
first, to the shard with the least load. Groups of equal size are
interchangeable, so the heap runs over size classes with their counts: sizes of
up to ``SIZE_BITS`` significant bits are classes of their own, larger ones share
the classes of their leading bits and count with their mean. That bounds the
classes, hence what reaches the driver, by ``2 ** SIZE_BITS`` a factor of two in
size, whatever the number of groups.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starsift.session import stored

SIZE_BITS = 12
#: Rows ranked in one task at most, about.
RANKED = 100_000


def lpt(classes: list[tuple[float, int]], shards: int) -> list[list[int]]:
    """Groups of each class for each shard; classes are (size, groups), largest size first.

    A shard is popped from the heap per group until the loads differ by at most
    one size; from then on the heap would go round, so whole rounds are dealt at once.
    """
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for size, count in classes:
        given = [0] * shards
        while count:
            low, top = heap[0][0], max(heap)[0]
            if count >= shards and top - low <= size:
                turns = count // shards
                heap = [(load + turns * size, s) for load, s in heap]
                given = [g + turns for g in given]
                count -= turns * shards
                continue
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, s))
            given[s] += 1
            count -= 1
        out.append(given)
    return out


def _ranked(df: DataFrame, by: list[str], total: str, order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """``out``: gapless position from 0 within ``by``; with ``weight``, of the first of so many.

    Rows are dealt by a hash to buckets of about ``RANKED`` rows (``total`` has the
    rows of a group), counted per bucket and ranked inside it.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.greatest(F.ceil(F.col(total) / RANKED), F.lit(1))))
    amount = F.sum(weight) if weight else F.count("*")
    counts = df.groupBy(*by, "_b").agg(amount.alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    if weight:
        upto = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        upto = F.row_number().over(inside) - 1
    return df.join(starts, [*by, "_b"]).withColumn(out, F.col("_s") + upto).drop("_b", "_s")


def shard(docs: DataFrame, shards: int = 16, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Deal rows to ``shards`` shards of nearly equal bytes, equal texts together.

    Returns a row per row: ``doc_id, size`` (UTF-8 bytes plus 1; a null text has
    none and counts as empty)``, text_crc32, law`` ('bytes')``, shard, slot``
    (gapless from 0 in a shard)``, grown_shard`` (null). Repeated rows get slots of
    their own. A group larger than a fair share fills its shard alone as far as
    the others allow. Ties go to the smaller shard number.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.md5(t.cast("binary"))).alias("text_key"),
    )
    # Rows alike are counted, so that ranking and joins see each once.
    rows = stored(rows.groupBy("doc_id", "size", "text_crc32", "text_key").agg(F.count("*").alias("copies")), "rows")
    exponent = F.greatest(F.floor(F.log2(F.col("bytes"))) - (SIZE_BITS - 1), F.lit(0)).cast("int")
    groups = stored(
        rows.groupBy("text_key").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"))
        .withColumn("step", F.pow(F.lit(2), exponent).cast("long"))
        .withColumn("class", F.col("bytes") - F.pmod("bytes", "step")).drop("step"),
        "groups",
    )
    classes = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    table = classes.orderBy(F.col("class").desc()).toPandas()
    given = lpt([(b / n, n) for b, n in zip(table.bytes.tolist(), table.n.tolist())], shards)
    plan = docs.sparkSession.createDataFrame(
        pd.DataFrame({"class": table["class"], "n": table.n, "given": given}), "class long, n long, given array<long>"
    )
    # The first given[0] groups of a class go to shard 0, the next given[1] to shard 1, and so on.
    placed = _ranked(groups.join(plan, "class"), ["class"], "n", ["text_key"], "place")
    upto = F.aggregate(
        "given", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shard")),
        lambda a, g: F.struct(
            (a["sum"] + g).alias("sum"),
            (a["shard"] + F.when(a["sum"] + g <= F.col("place"), 1).otherwise(0)).alias("shard"),
        ),
    )
    placed = stored(placed.select("text_key", upto["shard"].alias("shard")), "placed")
    dealt = stored(rows.join(placed, "text_key"), "dealt")
    totals = dealt.groupBy("shard").agg(F.count("*").alias("total"))
    slots = _ranked(dealt.join(F.broadcast(totals), "shard"), ["shard"], "total", ["doc_id", "text_key"], "first", "copies")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.expr("sequence(first, first + copies - 1)")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, key: str = "doc_id") -> None:
    """Write the rows of ``docs`` under ``path``, one folder per shard; ``key`` must be unique."""
    to = placed.select(F.col("doc_id").alias(key), "shard")
    docs.join(to, key).repartition("shard", F.pmod(F.xxhash64(key), F.lit(64))).write.partitionBy("shard").parquet(path)
