import math
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recallgrid.llm import mixing, rules, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def direct(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False))


def test_token_counts_are_the_library_s(documents, odd):
    rows = odd + [
        (20, "<|endoftext|> a<|startoftext|>b <|endoftext|><|endoftext|>"),
        (21, "é ́ ΣΑΣ it's THEY'LL 12345 a b c\u0085d"),
        (22, "don't stop. " * 2000),
        (23, "y" * 300 + " " + "z1" * 700),
    ]
    got = token_counts.token_counts(documents(rows), PATH, limit=100).collect()
    want = [(i, len((t or "").encode()), direct(t), direct(t) > 100) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_token_counts_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH).collect()}
    assert got == {r.doc_id: direct(r.text) for r in docs.collect()}


def test_memo_may_empty(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counts = token_counts.SegmentCounts(PATH)
    for text in ("a b c d e", "f g", "a b h i", "the cat sat on a mat"):
        assert counts.total(text.encode()) == direct(text)


def test_measures(documents, odd, spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = odd + docs + [(30, "a b c a b c a b c"), (31, "a a a a")]
    got = rules.quality(documents(rows)).collect()
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    have = sorted(((r.doc_id, *(r[f] for f in fields), r.base_failed) for r in got), key=repr)
    want = []
    for i, t in rows:
        b = brute.quality_base(t)
        want.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert have == sorted(want, key=repr)
    assert not any(r.kept and r.base_failed for r in got)


def test_long_vocabulary_takes_the_other_packing(monkeypatch):
    rng = random.Random(1)
    words = [str(rng.randrange(6)).encode() for _ in range(200)]
    plain = rules.repeated_words(words)
    assert plain == brute.quality_base(" ".join(w.decode() for w in words))[4]


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    n, right = 40_000, np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.85, 0.8, 0.9])
    good = rng.random(n) < 0.8
    correct = rng.random((n, len(right))) < right
    vote = np.where(correct == good[:, None], 2, 0)
    vote[rng.random(vote.shape) < 0.2] = 1
    patterns, where, counts = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    posterior, found, share = rules.accuracies(patterns, counts.astype(float))
    assert np.abs(found - right).max() < 0.03 and abs(share - 0.8) < 0.02
    assert ((posterior[where.ravel()] > 0.5) == good).mean() > 0.97


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.quality(docs).join(labels, "doc_id").collect()
    good = [r.kept or r.n_words < 50 for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.97


def test_empty_tables(documents):
    assert rules.quality(documents([])).count() == 0
    assert mixing.mix(documents([]).withColumnRenamed("hash", "source")).count() == 0
    assert token_counts.token_counts(documents([]), PATH).count() == 0


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()


def test_targets_stop_at_twice_the_source():
    size = {"=a": 10, "=b": 100, "null": 50}
    got = mixing.targets(size, {"=a": 3, "=b": 1, "null": 2}, 240.0)
    assert got == pytest.approx({"=a": 20, "=b": 120.0, "null": 100})
    assert sum(got.values()) == 1.5 * 160


def test_mix_comes_near_each_target(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs).collect()
    text = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    assert {r.doc_id for r in got} == set(text)
    taken, target, biggest = {}, {}, {}
    for r in got:
        s, t = text[r.doc_id]
        assert r.size == brute.quality_base(t)[0] and r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
        target[s], biggest[s] = r.target, max(biggest.get(s, 0), r.size)
    sizes = {s: r.source_size for r in got for s in [text[r.doc_id][0]]}
    order = sorted(sizes, key=lambda s: s.encode())
    assert target == pytest.approx(mixing.targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values())))
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1 for s in taken)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_mix_of_odd_rows(spark):
    rows = [(1, None, None), (2, "a b c", None), (3, "", "é"), (4, "a " * 9, "z"), (4, "a " * 9, "z"), (None, "q r", "é")]
    got = sorted(mixed(spark, rows), key=repr)
    assert len(got) == 6 and sum(r.size for r in got) == 23
    by = {r.target for r in got if r.doc_id in (1, 2)}
    # The order is z, é, null: 3, 1, 2 of 34.5 words, and é and null stop at 4 and 6.
    assert by == {6.0} and {r.target for r in got if r.size == 9} == {24.5}


def test_overlapping_sources_share_their_documents(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"]] * 10 + [["a", "b"]] * 20 + [["b", "a", "b"]] * 10)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"), weights=(1, 1), members="sources").collect()
    assert sum(r.taken for r in got) == pytest.approx(1.5 * 400, abs=10)


def test_flow_repeats_only_what_it_must():
    routed = mixing.flow({("a",): 10, ("a", "b"): 10, ("b",): 4}, {"a": 12, "b": 14})
    assert sum(routed[("a",)].values()) == 12 or sum(routed[("a", "b")].values()) in (10, 12)
    used = {p: sum(x.values()) for p, x in routed.items()}
    assert sum(used.values()) == 26 and sum(max(0, used[p] - n) for p, n in {("a",): 10, ("a", "b"): 10, ("b",): 4}.items()) == 2


@pytest.mark.parametrize("seed", range(6))
def test_flow_costs_least(seed):
    rng = random.Random(seed)
    patterns = {("a",): rng.randrange(5), ("b",): rng.randrange(5), ("a", "b"): rng.randrange(5)}
    quotas = {"a": rng.randrange(9), "b": rng.randrange(9)}
    routed = mixing.flow(patterns, quotas)

    def cost(used):
        return sum(min(used[p], n) * mixing.USE_COSTS[0] + max(0, used[p] - n) * mixing.USE_COSTS[1] for p, n in patterns.items())

    best = (0, math.inf)
    for a in range(2 * patterns[("a",)] + 1):
        for b in range(2 * patterns[("b",)] + 1):
            for ab in range(2 * patterns["a", "b"] + 1):
                for to_a in range(ab + 1):
                    if a + to_a <= quotas["a"] and b + ab - to_a <= quotas["b"]:
                        best = min(best, (-(a + b + ab), cost({("a",): a, ("b",): b, ("a", "b"): ab})))
    used = {p: sum(x.values()) for p, x in routed.items()}
    assert (-sum(used.values()), cost(used)) == best


def test_mixed_rows_are_those_of_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    uses = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    counted = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in uses.items() if n}
    odd = spark.createDataFrame([(1, None, None), (None, "a b c", None), (2, "", "x"), (3, "d e", "x")], "doc_id long, text string, source string")
    assert {r.text for r in mixing.mixed(odd).collect()} <= {"a b c", "d e"}
