import random

import pyarrow as pa
import pytest

from recallgrid.llm import graph, signatures


def smallest(edges):
    """Smallest node reachable, by node, over all edges."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            u, v = root(a), root(b)
            parent[max(u, v)] = min(u, v)
    return {x: root(x) for x in list(parent)}


def shuffles(monkeypatch):
    """The shuffles of each frame that is stored from now on."""
    found, plain = [], graph.stored

    def stored(frame, name):
        found.append(frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return plain(frame, name)

    monkeypatch.setattr(graph, "stored", stored)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(graph, "HELD", (2, 10, 500_000)[seed % 3])
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range((150, 250, 400, 2000)[seed])]
    edges += edges[:40] + [(b, a) for a, b in edges[:40]] + [(ids[0], ids[0])]
    path = ids[200:300]
    edges += zip(path, path[1:], strict=False)
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    rows = graph.components(frame).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.component for r in rows} == smallest(edges)


def test_odd_edges(spark):
    for edges in ([], [(3, 3)], [(None, 1), (2, None)]):
        assert graph.components(spark.createDataFrame(edges, "a long, b long")).collect() == []


def test_stars_join_what_the_edges_join(monkeypatch):
    edges = [(5, 4), (4, 3), (9, 8), (3, 9), (5, 3), (7, 6)]
    for held, most in ((500_000, 5), (1, 6)):
        monkeypatch.setattr(graph, "HELD", held)
        batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in part], graph._EDGES) for part in (edges[:3], [], edges[3:])]
        out = [(r["a"], r["b"]) for batch in graph.stars(iter(batches)) for r in batch.to_pylist()]
        assert len(out) <= most and all(a > b for a, b in out) and smallest(out) == smallest(edges)


def test_shuffles_of_a_round(spark, monkeypatch):
    """Stars are known for stars by one shuffle, and a round takes two joins and no more."""
    found = shuffles(monkeypatch)
    star = [(0, i) for i in range(1, 300)]
    assert {r.component for r in graph.components(spark.createDataFrame(star, "a long, b long").repartition(3)).collect()} == {0}
    assert sum(found) == 1
    found.clear()
    path = [(i, i + 1) for i in range(64)]
    assert {r.component for r in graph.components(spark.createDataFrame(path, "a long, b long").repartition(16)).collect()} == {0}
    rounds = (len(found) - 2) // 4
    assert 1 <= rounds <= 6 and sum(found) <= 1 + 5 * rounds


def test_chunks_of_one_class_do_not_meet(spark, documents, monkeypatch):
    """A large group whose sets the first walk has joined needs no comparison of its chunks."""

    def across(*_):
        raise AssertionError("compared")

    monkeypatch.setattr(signatures, "CHUNK", 10)
    monkeypatch.setattr(signatures, "_across", across)
    words = [f"b{i}" for i in range(200)]
    rows = [(100 + i, " ".join([*words[: 3 * i], f"new{i}", *words[3 * i + 1 :]])) for i in range(60)]
    assert {r.component_id for r in signatures.similar_sets(documents(rows)).collect()} == {100}
