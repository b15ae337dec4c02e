"""Rows that share a doc_id or have none, and columns whose names clash."""

import random
import time

import corpus_pipeline as pipeline
from recallgrid.llm import language, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "completely other words stand in this second text of the same number so nothing links them"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b = "one text of some words that is there twice or more", "a third text that only stands here and has no partner"
    rows = [(1, a), (1, LONG), (2, a), (2, a), (None, b), (None, b), (None, b), (None, a), (7, LONG), (8, "x"), (8, "x"), (8, "y")]
    got = sorted(((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()), key=repr)
    assert got == sorted([(1, a), (1, LONG), (None, b), (8, "x"), (8, "y")], key=repr)


def test_language_rejects_rows_not_ids(spark, sf):
    rows = [(100_000 + i, "the house and the thing with that") for i in range(20)]
    odd = [(100_001, "12 34 !!"), (None, "12 34 !!"), (None, "the house and the thing with that")]
    got = [(r.doc_id, r.text) for r in pipeline.identify_language(spark, frame(spark, rows + odd), sf).collect()]
    assert sorted(got, key=repr) == sorted(rows + odd[2:], key=repr)


def test_clashing_columns_do_not_switch_the_mix(spark):
    rows = [(i, "a b c", s) for i, s in enumerate("xxyy")] + [(None, "a b", "x"), (None, "c d e f", "y"), (1, "other words", "y")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(plain).collect()), key=repr)
    for kind in ("string", "array<string>"):
        odd = spark.createDataFrame([(*r, "z" if kind == "string" else ["z"], 9, 9) for r in rows], f"doc_id long, text string, source string, sources {kind}, size int, hash int")
        assert sorted(map(tuple, mixing.mix(odd).collect()), key=repr) == want
        used = [(r.doc_id, r.text) for r in mixing.mixed(odd).collect()]
        taken = sum(r[-1] for r in want)
        assert sum(len(t.split()) for _, t in used) == taken and {t for i, t in used if i is None} <= {"a b", "c d e f"}


def test_many_sources_take_little_time():
    rng = random.Random(1)
    sizes = {f"s{i:06}": rng.randrange(1, 1000) for i in range(100_000)}
    total = 1.5 * sum(sizes.values())
    start = time.perf_counter()
    target = mixing.targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}, total)
    got = mixing.routed({(s,): n for s, n in sizes.items()}, {s: round(t) for s, t in target.items()})
    assert time.perf_counter() - start < 10
    assert abs(sum(target.values()) - total) < 1 and all(target[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert all(got[s,][s] == min(2 * sizes[s], round(target[s])) for s in sizes)


def test_all_pages_of_a_document_count(spark):
    url = lambda host, i: f"https://{host}/en/{i}"
    pages = [(1, url("a.example.com", 5), "<html>"), (2, url("b.example.org", 5), '<html lang="de">'), (3, url("b.example.org", 5), '<html lang="de">'), (4, "no url", ""), (5, None, None)]
    found = language.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.doc_id, r.host, r.declared or "", r.n_pages) for r in found) == [(5, "a.example.com", "", 1), (5, "b.example.org", "de", 2)]
    rows = [(i, "the house with that thing " * 4, "en", "s") for i in range(30)] + [(i, "der ungleich schon nicht zwei " * 4, "de", "s") for i in range(30, 60)]
    docs = spark.createDataFrame([*rows, (5, "xq", None, "s")], "doc_id long, text string, lang string, source string")
    pages += [(100 + i, url("c.example.org", i), '<html lang="de">') for i in range(30, 60)]
    got = language.identify(docs, language.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert len(got) == 61 and {(r.host, r.declared) for r in got if r.doc_id == 5} == {("b.example.org", "de")}
