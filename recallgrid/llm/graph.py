"""Connected components over a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import batch_of
from recallgrid.sources.storage import stored

#: Nodes that a task holds at once while it joins the edges it reads.
HELD = 500_000

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: what they join hangs on its smallest node, each other node once."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def hung() -> pa.RecordBatch:
        nodes = list(parent)
        return batch_of(_EDGES, [nodes, [root(x) for x in nodes]])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) >= HELD:
            yield hung()
            parent.clear()
    if parent:
        yield hung()


def _joined(edges: DataFrame) -> DataFrame:
    return stored(edges.mapInArrow(stars, "a long, b long"), "edges")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in edges a, b.

    Alternates large-star and small-star steps: each node's larger neighbours
    are hung on its smallest one, then its smaller neighbours. Before each
    round every task turns the edges it reads into stars, which drops repeats
    and shortens paths without a shuffle. The smallest neighbour is a partial
    aggregate, so a busy node gathers nowhere; the same aggregate tells
    whether stars are all that is left, and is then the result. Steps make no
    more edges than they read. Each is stored, so lost executors cost one
    step. Rounds grow with the logarithm of the longest path. Nodes without
    an edge are not listed; loops and repeated edges change nothing; an empty
    list gives no rows.
    """
    now = _joined(edges.filter("a <> b").select("a", "b"))
    while True:
        near = _both_ways(now).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        # In a star the middle has larger neighbours only, any other node one neighbour.
        open_ = (F.col("low") < F.col("u")) & (F.col("low") < F.col("high"))
        near = stored(near.select(F.col("u").alias("node"), F.least("u", "low").alias("component"), open_.alias("open")), "least")
        least = near.select("node", "component")
        if near.filter("open").isEmpty():
            return least
        # Every edge runs from a larger node to a smaller one.
        large = stored(now.join(least, F.col("b") == F.col("node")).select("a", F.col("component").alias("b")), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        # An edge to the smallest neighbour stays, any other hangs that neighbour on it.
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = _joined(stored(small, "edges"))
