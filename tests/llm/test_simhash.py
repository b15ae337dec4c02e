import random

import brute
import pytest

from recallgrid.llm import graph, simhash


def checked(frame, rows):
    got = sorted((tuple(r) for r in simhash.near_duplicates(frame).collect()), key=repr)
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{p:016x}", g) for (i, p), g in zip(prints, brute.groups(prints), strict=True)), key=repr)
    assert got == want


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    checked(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(documents, odd):
    checked(documents(odd), odd)


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(3000))
    want = brute.fingerprint(text)
    real = simhash.pieces
    monkeypatch.setattr(simhash, "pieces", lambda data: real(data, 64))
    assert simhash.fingerprint(text.encode()) == want


def linked(spark, prints):
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "bits long")
    found = graph.components(simhash.links(frame)).collect()
    mask = (1 << 64) - 1
    by = {r.node & mask: r.component & mask for r in found}
    return [by.get(p, p) for p in prints]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("few", [1, 4, 10_000])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(few)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(prints)[:4]:
        x = centre
        for _ in range(30):
            for _ in range(rng.choice((1, 2, 2, 3, 4))):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
        prints |= {centre ^ (1 << i) ^ (1 << j) for i in range(0, 12) for j in range(12, 16)}
    prints = sorted(prints)
    ids = brute.groups([(p, p) for p in prints])
    assert same_partition(linked(spark, prints), ids)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(500)] + [(5, 5), (0, 1)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1501)}
