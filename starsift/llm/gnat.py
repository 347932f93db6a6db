"""Hard negatives by a multiway hyperplane tree (GNAT).

A node has split points; a row goes down to its nearest one. For each split point a
node keeps the range of its distances to the rows under every sibling. The tree is
grown from a bounded sample, the ranges are taken over all rows, and every row
lies in a leaf.

A window of inner products around an anchor is an annulus of distances, given
the range of norms under a child. A child is eliminated if, for some split
point, no row within the point's range can lie in any annulus. The leaves that are
left are compared exactly, so results do not depend on the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starsift.session import stored

#: Rows the tree is grown from, split points of a node, sampled rows of a leaf, levels.
SAMPLE_ROWS, DEGREE, LEAF_ROWS, LEVELS = 4096, 8, 128, 8
#: Rows in a block of a leaf, and anchors that meet a block together.
ROW_BLOCK, ANCHOR_BLOCK = 8192, 4096
#: Squared norms stay below this, so that products fit in a long.
MOST_SQUARE = 2.0**62
_SLACK = 1e-6
_LOW, _HIGH = -(2**63), 2**63 - 1


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    out = np.zeros((len(column), width))
    for at, v in enumerate(column):
        out[at, : len(v)] = v
    return out


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2.0 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0.0))


@dataclass
class Node:
    """Split points, and under each a node (its place) or a leaf (-1 - its place)."""

    points: np.ndarray
    children: list[int]
    # From each split point (first axis) to the rows under each (second axis); empty subtrees keep inf, -inf.
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    least: np.ndarray = field(init=False)  # squared norms under each
    most: np.ndarray = field(init=False)

    def __post_init__(self):
        k = len(self.points)
        self.low, self.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        self.least, self.most = np.full(k, np.inf), np.full(k, -np.inf)


@dataclass
class Tree:
    """Nodes, the root first, and the number of leaves. Without nodes there is one leaf."""

    width: int
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 0

    def parts(self) -> tuple:
        """Plain arrays, which a broadcast can carry to tasks that cannot import this module."""
        return self.width, self.leaves, [dict(vars(n)) for n in self.nodes]

    @classmethod
    def of(cls, parts: tuple) -> Tree:
        tree = cls(parts[0], leaves=parts[1])
        for held in parts[2]:
            tree.nodes.append(node := Node(held["points"], held["children"]))
            vars(node).update(held)
        return tree

    @classmethod
    def grow(cls, sample: np.ndarray, degree: int = DEGREE, leaf_rows: int = LEAF_ROWS, levels: int = LEVELS) -> Tree:
        """Split points are far from each other among a few rows drawn from the node's sample."""
        tree, draw = cls(sample.shape[1]), np.random.default_rng(0)

        def add(x: np.ndarray, level: int) -> int:
            points = tree._spread(x[draw.permutation(len(x))[: 3 * degree]], degree) if len(x) > leaf_rows else x[:0]
            if len(points) < 2 or level == levels:
                tree.leaves += 1
                return -tree.leaves
            place = len(tree.nodes)
            tree.nodes.append(Node(points, []))
            near = _distances(x, points).argmin(axis=1)
            tree.nodes[place].children = [add(x[near == j], level + 1) for j in range(len(points))]
            return place

        add(sample, 0)
        return tree

    @staticmethod
    def _spread(x: np.ndarray, count: int) -> np.ndarray:
        chosen, apart = [0], _distances(x, x[:1])[:, 0]
        while len(chosen) < count and apart.max() > 0:
            chosen.append(int(apart.argmax()))
            apart = np.minimum(apart, _distances(x, x[chosen[-1:]])[:, 0])
        return x[chosen]

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows, distances to its split points, nearest one) of all nodes that rows come through."""
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            place, rows = todo.pop()
            node = self.nodes[place]
            apart = _distances(x[rows], node.points)
            near = apart.argmin(axis=1)
            yield place, rows, apart, near
            for j, child in enumerate(node.children):
                under = rows[near == j]
                if child >= 0 and len(under):
                    todo.append((child, under))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for place, rows, _, near in self.walk(x):
            child = np.array(self.nodes[place].children)[near]
            out[rows[child < 0]] = -1 - child[child < 0]
        return out

    def left(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, anchors) that no range eliminates; ``low`` and ``high`` hold each anchor's windows of products."""
        if not self.nodes:
            yield 0, np.arange(len(x))
            return
        square = (x * x).sum(axis=1)
        todo = [(0, np.arange(len(x)))]
        while todo:
            place, rows = todo.pop()
            node = self.nodes[place]
            apart = _distances(x[rows], node.points)
            slack = _SLACK * (1.0 + np.sqrt(square[rows])[:, None] + np.sqrt(np.maximum(node.most, 0.0)))
            for j, child in enumerate(node.children):
                if node.most[j] < 0:  # nothing under it
                    continue
                # Distances between an anchor and any row under j, by every split point.
                near = np.maximum(np.maximum(apart - node.high[:, j], node.low[:, j] - apart), 0.0).max(axis=1)
                far = (apart + node.high[:, j]).min(axis=1)
                # Windows of products as annuli of distances.
                inner = np.sqrt(np.maximum(square[rows, None] + node.least[j] - 2.0 * high[rows], 0.0))
                outer = np.maximum(square[rows, None] + node.most[j] - 2.0 * low[rows], -1.0)
                possible = (low[rows] <= high[rows]) & (outer >= 0)
                outer = np.sqrt(np.maximum(outer, 0.0))
                edge = slack[:, j, None]
                met = (possible & (inner <= far[:, None] + edge) & (outer >= near[:, None] - edge)).any(axis=1)
                if met.any():
                    if child >= 0:
                        todo.append((child, rows[met]))
                    else:
                        yield -1 - child, rows[met]


def usable(vectors: DataFrame, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """(uid, id, label, v) of rows that take part; components become ``floor(scale * x)``."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    return (
        vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
        .select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
        .where(square < MOST_SQUARE)
        .select(F.monotonically_increasing_id().alias("uid"), "id", "label", "v")
    )


def index(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, **shape) -> tuple[Tree, DataFrame, dict[int, int]]:
    """The tree with its ranges over all rows, the rows with their ``leaf``, and the rows of each leaf."""
    sc = rows.sparkSession.sparkContext
    # The rows whose identities hash lowest: at most ``sample_rows`` reach the driver.
    low = rows.select(F.xxhash64("id", "v").alias("h"), "v").orderBy("h", "v").limit(sample_rows).toPandas()
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    tree = Tree.grow(_matrix(low.v, width), **shape)
    shared = sc.broadcast(tree.parts())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree.of(shared.value)
        for batch in batches:
            yield batch.assign(leaf=tree.leaf_of(_matrix(batch.v, width)))

    placed = stored(rows.mapInPandas(place, "uid long, id long, label long, v array<double>, leaf long"), "leaves")

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, found = Tree.of(shared.value), {}
        for batch in batches:
            x = _matrix(batch.v, width)
            square = (x * x).sum(axis=1)
            for node, under, apart, near in tree.walk(x):
                for j in np.unique(near):
                    mine = near == j
                    own = square[under[mine]]
                    pairs = [*zip(apart[mine].min(axis=0), apart[mine].max(axis=0)), (own.min(), own.max())]
                    for i, (least, most) in enumerate(pairs):
                        held = found.setdefault((node, int(j), i), [least, most])
                        held[:] = min(held[0], least), max(held[1], most)
        yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["node", "j", "i", "least", "most"])

    spans = (
        placed.mapInPandas(ranges, "node long, j long, i long, least double, most double")
        .groupBy("node", "j", "i").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    )
    for r in spans.collect():  # at most (points + 1) rows for each split point of the tree
        node = tree.nodes[r.node]
        if r.i == len(node.points):
            node.least[r.j], node.most[r.j] = r.least, r.most
        else:
            slack = _SLACK * (1.0 + r.most + float(np.linalg.norm(node.points[r.i])))
            node.low[r.i, r.j], node.high[r.i, r.j] = r.least - slack, r.most + slack
    sizes = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    return tree, placed, sizes


def _visits(anchors: DataFrame, tree: Tree, blocks: dict[int, int], parts: int, own_leaf: bool = False) -> DataFrame:
    """Each anchor once for every block of every leaf that its windows (``lows``, ``highs``) may meet."""
    shared = anchors.sparkSession.sparkContext.broadcast(tree.parts())
    names = ["uid", "label", "v", "lows", "highs"]

    def bounds(column: pd.Series, fill: float, ends: int) -> np.ndarray:
        out = np.full((len(column), max(map(len, column), default=1) or 1), fill)
        for at, w in enumerate(column):
            out[at, : len(w)] = w
        # A long at its end stands for no bound.
        return np.where(out == float(ends), np.sign(ends) * np.inf, out)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree.of(shared.value)
        for batch in batches:
            x = _matrix(batch.v, tree.width)
            if own_leaf:
                leaf = tree.leaf_of(x)
                met = [(at, np.flatnonzero(leaf == at)) for at in np.unique(leaf)]
            else:
                # Windows that are not there are empty: no product is both as large and as small.
                met = tree.left(x, bounds(batch.lows, np.inf, _LOW), bounds(batch.highs, -np.inf, _HIGH))
            for leaf, rows in met:
                for block in range(blocks.get(leaf, 0)):
                    yield batch.iloc[rows][names].assign(
                        leaf=leaf, block=block, part=batch.uid.iloc[rows].to_numpy() % parts
                    )

    return anchors.mapInPandas(
        deal, "uid long, label long, v array<double>, lows array<long>, highs array<long>, leaf long, block long, part long"
    )


def _compare(rows: DataFrame, visits: DataFrame, width: int, same: bool, most: int) -> DataFrame:
    """(anchor, at, uid, id, score): the first ``most`` rows in every window of each anchor, block by block."""
    schema = "anchor long, at int, uid long, id long, score long"

    def scan(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            rows = rows.sort_values(["id", "uid"], ignore_index=True)
            x, q = _matrix(rows.v, width), _matrix(anchors.v, width)
            reach = np.sqrt((x * x).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1).max())
            if reach < 2**52:  # doubles hold every partial sum
                products = (q @ x.T).astype(np.int64)
            else:
                products = q.astype(np.int64) @ x.astype(np.int64).T
            label, uid, key = rows.label.to_numpy(), rows.uid.to_numpy(), rows.id.to_numpy()
            for a, s in zip(anchors.itertuples(index=False), products):
                fit = np.flatnonzero(((label == a.label) if same else (label != a.label)) & (uid != a.uid))
                fit = fit[np.argsort(-s[fit], kind="stable")]
                score = s[fit]
                for at, (low, high) in enumerate(zip(a.lows, a.highs)):
                    first = fit[(score >= low) & (score <= high)][:most]
                    out.append((np.full(len(first), a.uid), np.full(len(first), at), uid[first], key[first], s[first]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 5
        return pd.DataFrame(dict(zip(("anchor", "at", "uid", "id", "score"), columns)))

    keys = ("leaf", "block", "part")
    found = rows.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(scan, schema)
    order = Window.partitionBy("anchor", "at").orderBy(F.col("score").desc(), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, anchor: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, **tree_shape,
) -> DataFrame:
    """For each anchor and each of its positives, the hardest negatives.

    Components become ``floor(scale * x)``; a score is the integer inner product of two such vectors, higher
    first, ties to the smaller id. ``anchor`` is a condition on (id, label) that picks the anchors. An anchor's positives
    are its first ``positives`` other rows of the same label. Negatives are the first ``negatives`` rows of
    another label with ``low * positive_score <= 100 * score <= high * positive_score``.

    Returns ``anchor_id, positive_id, rank`` (from 1)``, negative_id, positive_score, negative_score``.
    Rows with a null id, label or vector, a null or non-finite component or a squared norm of 2^62 or
    more after scaling take no part. Shorter vectors are filled up with zeros. Repeated
    rows are rows of their own. A negative positive score leaves no window, hence no row. No
    rows give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector, label, scale), "vectors")
    tree, placed, sizes = index(rows, **tree_shape)
    blocks = {leaf: -(-n // ROW_BLOCK) for leaf, n in sizes.items()}
    anchors = placed.where(anchor).select("uid", "id", "label", "v")
    parts = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    dealt = F.broadcast(spark.createDataFrame(sorted(blocks.items()), "leaf long, blocks long"))
    laid = placed.join(dealt, "leaf").select(
        "uid", "id", "label", "v", "leaf", F.pmod(F.xxhash64("uid"), "blocks").alias("block"),
        F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"),
    )

    def first(windows: DataFrame, same: bool, most: int, **how) -> DataFrame:
        return _compare(laid, _visits(windows, tree, blocks, parts, **how), tree.width, same, most)

    no_bound = F.array(F.lit(_HIGH))
    # What an anchor finds in its own leaf says how good its positives are at least.
    probe = anchors.select("uid", "label", "v", F.array(F.lit(_LOW)).alias("lows"), no_bound.alias("highs"))
    known = stored(
        first(probe, True, positives, own_leaf=True).groupBy(F.col("anchor").alias("uid"))
        .agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= positives),
        "probe",
    )
    ranged = anchors.join(known, "uid", "left").select(
        "uid", "label", "v", F.array(F.coalesce("least", F.lit(_LOW))).alias("lows"), no_bound.alias("highs")
    )
    best = stored(first(ranged, True, positives).select("anchor", "rank", "id", "score"), "positives")
    # Windows in whole numbers: 100 s >= low p and 100 s <= high p.
    windows = best.groupBy(F.col("anchor").alias("uid")).agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", F.expr(f"cast(ceil(cast({low} as decimal(10,0)) * score / 100) as long)").alias("low"),
            F.expr(f"cast(floor(cast({high} as decimal(10,0)) * score / 100) as long)").alias("high"),
        ))).alias("w")
    )  # at most ``positives`` to an anchor
    searched = anchors.join(windows, "uid").select(
        "uid", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs")
    )
    found = first(searched, False, negatives)
    return (
        found.select("anchor", (F.col("at") + 1).alias("place"), F.col("rank").alias("rank"),
                     F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(best.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"),
                          F.col("score").alias("positive_score")), ["anchor", "place"])
        .join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                "negative_score")
    )
