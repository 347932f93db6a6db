"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.session import stored


def components(edges: DataFrame) -> DataFrame:
    """Edges ``(a long, b long)`` -> ``(node, root)``, the root being the smallest node reachable.

    Every node of an edge gets a row. Each round takes the smallest label of the
    neighbours and then the label's own label, so long chains shrink by half; a
    round's labels are written, which keeps lineage short. Nulls take no part.
    """
    edges = edges.where("a is not null and b is not null")
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("root")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "low").alias("root")
        )
        upper = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = stored(
            step.join(upper, "root").select("node", "old", F.least("root", "top").alias("root")),
            "labels",
        )
        if moved.where("root < old").limit(1).count() == 0:
            return moved.select("node", "root")
        labels = moved.select("node", "root")
