"""Connected components of an edge table, by contraction, and joins that a hot key doesn't slow down."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: A key with more than this share of the rows is looked up apart; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.01
#: So many edges, some megabytes, are settled in one task; each round before that makes them fewer.
FINISH = 100_000


def hot_keys(df: DataFrame, key: str) -> list:
    """All values of a column that have at least HOT_SHARE of the rows, and maybe some others; 1 / HOT_SHARE at most."""
    return [v for v in df.stat.freqItems([key], HOT_SHARE).first()[0] if v is not None]


def lookup(df: DataFrame, key: str, table: DataFrame, hot: list | None = None) -> DataFrame:
    """df left-joined with table on key, of which table has one row each.

    Rows with a hot key don't travel: their table rows, at most 1 / HOT_SHARE, are sent to every task instead.
    """
    hot = hot_keys(df, key) if hot is None else hot
    if not hot:
        return df.join(table, key, "left")
    among = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(table.where(F.col(key).isin(hot)))
    return df.where(~among).join(table.where(~among), key, "left").unionByName(df.where(among).join(few, key, "left"))


class Forest:
    """Union-find; roots are the smallest of their trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        up = self.up
        up.setdefault(i, i)
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges that are left -> (node, component)."""
    forest = Forest()
    for b in batches:
        for i, j in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            forest.union(i, j)
    nodes = list(forest.up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(i) for i in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached.

    Each round maps every node to the first in its neighbourhood, by a hash of the round's own, then to what that one maps to,
    and replaces the edges' ends by what they map to, until `finish` edges are left at most, which one task settles. As the
    order is a random one, a share of the nodes goes in every round, whatever the graph is like: a path takes a logarithm of
    its length. No node set goes to the driver. A node with very many edges, or one that very many map to, is looked up from a
    broadcast row. An empty table has no components; nulls aren't nodes.
    """
    left = materialise(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    labels, turn = None, 0
    while left.count() > finish:
        turn += 1
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("m"))  # noqa: E731, B023
        ends = left.select(F.col("b").alias("node"), place("a").alias("s")).union(left.select("a", place("b")))
        first = materialise(ends.groupBy("node").agg(F.min("s").alias("s")).select("node", F.least("s", place("node")).getField("m").alias("m")))
        to = materialise(lookup(first, "m", first.toDF("m", "mm")).select("node", F.col("mm").alias("component")))
        moved = lookup(left, "a", to.toDF("a", "to_a"))
        moved = lookup(moved, "b", to.toDF("b", "to_b"), hot_keys(left, "b"))
        left = materialise(moved.where("to_a <> to_b").selectExpr("least(to_a, to_b) a", "greatest(to_a, to_b) b").distinct())
        labels = to if labels is None else _follow(labels, to)
    last = materialise(left.repartition(1).mapInArrow(_settle, "node long, component long"))
    if labels is None:
        return last
    labels = _follow(labels, last)
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return materialise(lookup(labels, "component", least).select("node", F.col("least").alias("component")))


def _follow(labels: DataFrame, to: DataFrame) -> DataFrame:
    """labels, with components replaced by what they map to."""
    return materialise(lookup(labels, "component", to.toDF("component", "next")).select("node", F.coalesce("next", "component").alias("component")))
