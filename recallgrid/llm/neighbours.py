"""Nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.sources.storage import stored

SEED = 11
PROJECTIONS = 64
#: Half-width of a window at radius 1: a point at that distance falls into it with probability 0.82.
HALF_WIDTH = 1.35
#: Share of the projections in which a vector must meet the query to be verified.
COLLISIONS = 0.7
#: Growth of the radius from one virtual rehashing to the next.
GROWTH = 1.25
BLOCK_ROWS = 8192
QUERY_ROWS = 2048

_FOUND = "query_id long, vec_id long, score double"


def _usable(vector: str) -> Column:
    """Neither null nor zero, and no null or non-finite component."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        values = vectors @ self.axes
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)
        n, step = len(ids), max(1, len(ids) // 50)
        # The first windows hold about one vector in fifty.
        widths = self.sorted[:, step:] - self.sorted[:, : n - step] if n > step else np.zeros((1, 1))
        widest = float(np.abs(self.sorted).max(initial=0.0))
        self.first = max(float(np.median(widths)) / 2, widest * 1e-9, 1e-300)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The k nearest of each query: (query id, vector id, distance)."""
        n, n_queries = len(self.ids), len(ids)
        points = (queries @ self.axes).T
        least = math.ceil(COLLISIONS * PROJECTIONS)
        counts = np.zeros((n_queries, n), np.int16)
        low = np.empty((PROJECTIONS, n_queries), np.int64)
        for i in range(PROJECTIONS):
            low[i] = np.searchsorted(self.sorted[i], points[i])
        high = low.copy()
        found: list = [(np.empty(0), np.empty(0, np.int64))] * n_queries
        open_, half = list(range(n_queries)), self.first
        while open_:
            at = np.array(open_)
            new_low, new_high = np.empty((PROJECTIONS, len(at)), np.int64), np.empty((PROJECTIONS, len(at)), np.int64)
            for i in range(PROJECTIONS):
                # Both ends are included, so that rounding loses no equal vector.
                new_low[i] = np.searchsorted(self.sorted[i], points[i, at] - half, "left")
                new_high[i] = np.searchsorted(self.sorted[i], points[i, at] + half, "right")
            still = []
            for j, q in enumerate(open_):
                met = [self.order[i, new_low[i, j] : low[i, q]] for i in range(PROJECTIONS)]
                met += [self.order[i, high[i, q] : new_high[i, j]] for i in range(PROJECTIONS)]
                added = np.bincount(np.concatenate(met), minlength=n)
                before = counts[q]
                fresh = np.flatnonzero((before < least) & (before + added >= least))
                counts[q] = before + added
                fresh = fresh[self.ids[fresh] != ids[q]]
                distance, near = found[q]
                if len(fresh):
                    apart = self.vectors[fresh] - queries[q]
                    distance = np.concatenate([distance, np.sqrt((apart * apart).sum(1))])
                    near = np.concatenate([near, self.ids[fresh]])
                    keep = np.lexsort((near, distance))[:k]
                    distance, near = distance[keep], near[keep]
                    found[q] = distance, near
                all_met = (new_high[:, j] - new_low[:, j] >= n).sum() >= least
                if not all_met and not (len(near) == k and distance[-1] * HALF_WIDTH <= half):
                    still.append(q)
            low[:, at], high[:, at] = new_low, new_high
            open_, half = still, half * GROWTH
        return [
            (int(ids[q]), int(v), float(d)) for q in range(n_queries) for d, v in zip(*found[q], strict=True)
        ]


def _arrays(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column("embedding").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows.column(name).to_numpy(), values.reshape(len(rows), -1)


def _search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        rows = []
        if len(queries) and len(vectors):
            ids, values = _arrays(vectors, "vec_id")
            rows = Index(ids, values).nearest(*_arrays(queries, "query_id"), k)
        q, v, d = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table(
            {"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(d, pa.float64())}
        )

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest vectors of each query, by Euclidean distance in double precision.

    queries, vectors: vec_id long, embedding array<float>; other columns are
    not read. The vectors are dealt by hash into blocks of about BLOCK_ROWS,
    and each block of queries meets each block of vectors once. There every
    vector's projections on PROJECTIONS seeded axes stand in sorted arrays; a
    query's windows grow around its own projections by virtual rehashing, and
    a vector that falls into the windows of COLLISIONS of the axes is
    verified by its exact distance. A block is done when its kth distance is
    within the windows' radius, or when the windows hold the whole block. The
    blocks' results are merged by distance. Every vector is indexed; recall
    against brute force is measured in the tests.

    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part; a query only meets vectors of its own length. A row never
    meets rows of its own vec_id. Ties go to the smaller vec_id. Repeated
    vectors count one by one; a repeated query id is searched once, with the
    smallest of its vectors. Null ids take no part. Empty tables: no rows.
    """
    key = F.array_size("embedding").alias("length")
    good = vectors.filter(F.col("vec_id").isNotNull() & _usable("embedding")).select("vec_id", "embedding", key)
    asked = queries.filter(F.col("vec_id").isNotNull() & _usable("embedding"))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), "embedding", key), "queries")
    good = stored(good, "vectors")
    blocks = max(1, math.ceil(good.count() / BLOCK_ROWS))
    parts = max(1, math.ceil(asked.count() / QUERY_ROWS))
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    part_of = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", part_of.cast("int").alias("part"), each(blocks).alias("block"))
    right = good.select("*", block_of.cast("int").alias("block"), each(parts).alias("part"))
    keys = ["length", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
