import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.llm import language, pieces, toxicity

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pieces.held(PATH)


def ways(chunk):
    """All segmentations of a chunk, best first."""
    out = []

    def go(at, score, ids):
        if at == len(chunk):
            out.append((score, ids))
        for end in range(at + 1, min(len(chunk), at + MODEL.longest) + 1):
            found = MODEL.score.get(chunk[at:end])
            if found:
                go(end, score + found[0], [*ids, found[1]])
            elif end == at + 1:
                go(end, score + MODEL.unknown, ids + MODEL.spelt(chunk[at:end]))

    go(0, 0.0, [])
    return sorted(out, key=lambda w: -w[0])


def check_text(text, n=4):
    (cut, k, ids), = MODEL.encode([text])
    got = MODEL.alternatives(cut, k, n)
    best = ways(" " + text) if text else [(0.0, [])]
    assert [s for s, _ in got] == pytest.approx([s for s, _ in best[:n]], rel=1e-12)
    seen = set()
    for score, edits in got:
        way = ids.tolist()
        for token, replaced, new in sorted(edits, reverse=True):
            way[token : token + replaced] = new
        assert way in [w for s, w in best if s == pytest.approx(score, rel=1e-12)]
        assert MODEL.decode(way) == text.encode() and tuple(way) not in seen
        seen.add(tuple(way))


@pytest.mark.parametrize("text", ["", " ", "the cat", "  a  b ", "erß日本", "x\ny", "▁a", "\t\x00", "<s>", "éé ʁ"])
def test_n_best_segmentations(text):
    check_text(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="theing  \nß日▁", max_size=11))
def test_n_best_of_random_texts(text):
    check_text(text)


def test_pieces_are_those_of_the_model_file():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    (*_, ids), = MODEL.encode(["Thing and the cat, naïve 日本 \U0001f600\n"])
    assert model.decode(ids.tolist()) == "Thing and the cat, naïve 日本 \U0001f600\n"


def test_encoding_of_tables(spark, sf, documents, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    coded = pieces.encode(docs, PATH)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = coded.collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) and len(r.alternatives) <= 2 for r in rows)
    assert {r.doc_id: r.text for r in pieces.decode(coded, PATH).collect()} == text
    assert all(r.score >= a.score for r in rows for a in r.alternatives)
    got = pieces.encode(documents(odd), PATH).collect()
    assert len(got) == len(odd) and all(r.round_trip for r in got)
    assert pieces.encode(documents([]), PATH).count() == 0


def test_memo_of_chunks_may_empty(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    model = pieces.Pieces(PATH)
    for text in ("a b c d e f g h", "the cat sat", "x" * 200 + " y", "the cat sat"):
        (*_, ids), = model.encode([text])
        assert model.decode(ids.tolist()) == text.encode()


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def toxic_corpus(n, seed=1):
    rng = random.Random(seed)
    plain, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["vilebad", "nastier", "hatefulx"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        is_toxic = rng.random() < 0.2
        for _ in range(3 if is_toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, int(is_toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark, documents):
    docs, labels = toxic_corpus(1200)
    shown = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(documents([*docs, (None, "x"), (9000, None), (9001, "")]), shown).collect()}
    assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id) == 2) for r in got.values())
    assert got[9000].score == got[9001].score
    held = [(got[i].predicted, t) for i, t in labels if fold(i) == 2]
    right = sum(p == t for p, t in held)
    assert right / len(held) > 0.95


def test_held_out_labels_are_not_read(spark, documents):
    docs, labels = toxic_corpus(300)
    turned = [(i, 1 - t if fold(i) == 2 else t) for i, t in labels]
    a, b = (
        toxicity.toxicity(documents(docs), spark.createDataFrame(x, "doc_id long, toxic int")).collect() for x in (labels, turned)
    )
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_toxicity_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(documents([(1, "a b")]), none).collect()] == [0.0]
    assert toxicity.toxicity(documents([]), none).count() == 0


def test_models_of_both_classes_are_distributions(spark, documents):
    docs, labels = toxic_corpus(200)
    tables = toxicity.model(documents(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert tables["p0"].sum() == pytest.approx(1, rel=1e-3) and tables["p1"].sum() == pytest.approx(1, rel=1e-3)
    # The share of seen pairs and what the context leaves to the backoff make one.
    words = toxicity.slots(docs[0][1].encode())
    h = words[3]
    pairs = {(a, b) for _, t in docs for x in [toxicity.slots(t.encode())] for a, b in zip(toxicity.with_start(x), x, strict=True) if a == h}
    seen = toxicity.pair_slots(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert tables["d0"][np.unique(seen)].sum() + tables["l0"][h] == pytest.approx(1, abs=1e-3)


def test_language_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    rows = language.identify(docs, language.page_evidence(pages)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert sum(r.language == r.lang for r in rows) / len(rows) > 0.98
    assert sum(r.kept for r in rows) / len(rows) > 0.98
    # Labels of half the documents, answers for the other half.
    from pyspark.sql import functions as F

    half = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    unseen = [r for r in language.identify(half).collect() if r.doc_id % 2]
    assert sum(r.language == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97


def test_language_evidence_decides_where_the_text_is_silent(spark):
    rng = random.Random(3)
    say = {"en": ["the", "house", "thing", "with", "that"], "de": ["der", "ungleich", "schon", "nicht", "zwei"]}
    rows = [(i, " ".join(rng.choice(say[x]) for _ in range(40)), x, "s") for i, x in enumerate(["en", "de"] * 40)]
    rows += [(500, "qq", None, "s"), (501, "xqxq 中文 " * 400, None, "s"), (502, None, None, None), (503, "12 34 !!", "en", "s"), (500, "qq", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pages = [(i, f"http://h{x}.example.{x}/{x}/{i}?a=1", f"<!doctype html><HTML class=a LANG='{x}-XX'>") for i, _, x, _ in rows[:80]]
    pages += [(900, "http://hde.example.de/de/500", '<html lang="de">'), (901, None, None), (902, "x", ""), (903, "http://hen.example.en/en/500", "")]
    evidence = language.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.doc_id: r for r in language.identify(docs, evidence).collect()}
    assert all(got[i].language == x and got[i].kept for i, _, x, _ in rows[:80])
    assert got[500].language == "de" and not got[501].kept and not got[502].kept and not got[503].kept
    assert language.identify(docs.limit(0)).count() == 0


def test_own_vote_is_left_out_of_the_host(spark):
    rows = [(i, "the house with that thing " * 5, "en", "a") for i in range(10)] + [(20 + i, "der schon nicht zwei ungleich " * 5, "de", "b") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.language for r in language.identify(docs).collect() if r.doc_id < 20} == {"en"}
