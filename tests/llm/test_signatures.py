import random

import brute
import numpy as np
import pytest

from recallgrid.llm import signatures


def grams(text, n=5):
    words = brute.WORD.findall(brute.lower_ascii(text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain(rows, n=5):
    """(doc_id, size, smallest doc_id reachable) over all pairs."""
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in at[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, len(s), least.get(root(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def compared(frame, rows, **how):
    got = sorted(map(tuple, signatures.similar_sets(frame, **how).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)
    return got


def edited(words, rng, share):
    out = list(words)
    for _ in range(max(1, int(share * len(out)))):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def families(seed, n, vocabulary=400):
    """Bases with chains of edited copies, shared passages, prefixes at the border of a link."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    while len(rows) < n:
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 5, 6, 12, 40, 90, 200]))]
        if rng.random() < 0.4:
            base = base + passage
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            kind, copy = rng.random(), base
            if kind < 0.5:
                copy = edited(base, rng, rng.choice([0.005, 0.02, 0.04, 0.06]))
            elif kind < 0.8:
                copy = base[: rng.randrange(len(base) * 3 // 4, len(base)) + 1]
            rows.append((len(rows), " ".join(copy).title()))
            base = copy if rng.random() < 0.5 else base
    rng.shuffle(rows)
    return rows


def test_odd_texts(spark, documents, odd):
    rows = odd + [(70, "a b c d e f g"), (71, "A B  C\td e\nf G"), (72, "a b c"), (73, "A b c"), (74, "a b c d"), (None, "alone with a null id x y z")]
    got = compared(documents(rows), rows)
    assert (1, 0, 1) in got and (2, 0, 2) in got and (73, 1, 72) in got and (None, 5, None) not in got
    assert signatures.similar_sets(documents(rows).limit(0)).count() == 0
    nothing = [(5, None), (4, "")]
    compared(documents(nothing), nothing)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    compared(docs, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("chunk", [512, 6])
def test_families(spark, documents, monkeypatch, chunk):
    monkeypatch.setattr(signatures, "CHUNK", chunk)
    rows = families(chunk, 500)
    got = compared(documents(rows), rows)
    assert 50 < len({c for _, _, c in got}) < 450


def test_dense_group_of_several_classes(spark, documents, monkeypatch):
    """One group of sets that all share tokens: near copies of two texts, and chains between them that do not reach."""
    monkeypatch.setattr(signatures, "CHUNK", 10)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(edited(base, rng, 0.01))) for i in range(150)]
    rows += [(1000 + i, " ".join(base[: 70 + i])) for i in range(30)]
    rows += [(2000 + i, " ".join(base[:40] + [f"c{i % 7}x{j}" for j in range(60)])) for i in range(40)]
    rng.shuffle(rows)
    compared(documents(rows), rows)


def test_frequent_tokens_go_last():
    found = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 50, np.uint64))
    often = found[:20]
    first = signatures.prefix(found, often, np.full(20, 9), 11)
    assert len(first) == 11 and not set(first.tolist()) & set(often.tolist())
    assert signatures.prefix_length(1) == 1 and signatures.prefix_length(5) == 2 and signatures.prefix_length(50) == 11


@pytest.mark.parametrize("seed", range(20))
def test_linked_sets_share_what_is_asked(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
    for _ in range(30):
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.75, 1)], rng.integers(0, 1 << 64, rng.integers(0, 1 + n // 5), np.uint64)]))
        if len(y) and signatures.enough(signatures.overlap(x, y), len(x), len(y)):
            first = [set(z[: signatures.prefix_length(len(z), 80, signatures.asked(len(z)))].tolist()) for z in (x, y)]
            for z, w in ((x, y), (y, x)):
                assert len(first[0] & first[1]) >= signatures.asked(-(-80 * len(z) // 100))


def test_needed_is_what_partners_are_asked_for(spark):
    for least in (80, 75, 90):
        rows = spark.range(1, 3000).select("id", signatures._needed(signatures.F.col("id"), least).alias("n")).collect()
        assert all(r.n == signatures.asked(-(-least * r.id // 100), least) for r in rows)


def test_words_are_hashed_alike():
    a, b = (signatures.word_hashes(t.encode()) for t in ("One  twó\tOne 日本", "\n日本 tWó one "))
    assert a[0] == a[2] == b[2] and a[3] == b[0] and len({*a.tolist(), *b.tolist()}) == 3 and a[1] == b[1]
    long = "ab" * 600_000
    assert signatures.word_hashes(f"x {long}".encode())[1] == signatures.word_hashes(f"{long} y".encode())[0]
    assert len(signatures.tokens(f"x {long} y {long} z w".encode())) == 2


@pytest.mark.parametrize("seed", range(6))
def test_walk_loses_no_link(seed):
    rng = np.random.default_rng(seed)
    bases = [np.unique(rng.integers(0, 1 << 64, rng.integers(1, 5000 if seed == 5 else 120), np.uint64)) for _ in range(30)]
    sets = []
    for b in bases:
        for _ in range(int(rng.integers(1, 8))):
            keep = b[rng.random(len(b)) < rng.choice([1.0, 0.97, 0.9, 0.8])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 64, rng.integers(0, 3), np.uint64)])))
    sets = [s for s in sets if len(s)]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if signatures.enough(signatures.overlap(sets[i], sets[j]), len(sets[i]), len(sets[j]))}
    tree = signatures.Tree.of(sets, np.arange(len(sets)))
    met = [(int(p), int(q)) for i, j in signatures.walk(tree, tree) for p, q in zip(tree.order[i], tree.order[j], strict=True)]
    assert want <= {(max(p), min(p)) for p in met} and len(met) == len(set(met)) and len(met) < len(sets) ** 2 / 4
    half = len(sets) // 2
    a, b = signatures.Tree.of(sets[:half], np.arange(half)), signatures.Tree.of(sets[half:], np.arange(half, len(sets)))
    across = {(int(b.order[q]) + half, int(a.order[p])) for i, j in signatures.walk(a, b) for p, q in zip(i, j, strict=True)}
    assert {x for x in want if x[0] >= half > x[1]} <= across
