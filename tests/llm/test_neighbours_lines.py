import numpy as np
import pytest

from recallgrid.llm import lines, neighbours


def exact(queries, vectors, k):
    out = {}
    for q, v in queries:
        found = sorted((float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum())), i) for i, x in vectors if i != q)
        out[q] = found[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    queries = [r for r in rows if r[0] % 20 == 0]
    got = {}
    for r in neighbours.nearest(frame(spark, queries), frame(spark, rows)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    want = exact(queries, rows, 10)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q].values()}) for q in want)
    assert hits / (10 * len(want)) >= 0.97
    vector = {i: np.array(v, float) for i, v in rows}
    for q, ranked in got.items():
        assert sorted(ranked) == list(range(1, 11)) and [ranked[i] for i in sorted(ranked)] == sorted(ranked.values())
        assert all(s == pytest.approx(np.linalg.norm(vector[q] - vector[v]), rel=1e-12) for s, v in ranked.values())


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_index_recall(kind):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 32))
    if kind == "clusters":
        v = 0.05 * v + rng.standard_normal((10, 32))[rng.integers(0, 10, 3000)]
    if kind == "copies":
        v[500:1500] = v[500]
    v = v.astype(np.float32).astype(float)
    index = neighbours.Index(np.arange(3000), v)
    asked = np.arange(0, 3000, 100)
    got = {}
    for q, i, d in index.nearest(asked, v[asked], 10):
        got.setdefault(q, []).append((d, i))
    hits = 0
    for q in asked:
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        hits += len(set(want) & {i for _, i in got[int(q)]})
        if kind == "copies" and 500 <= q < 1500:
            assert [i for _, i in got[int(q)]] == [i for i in range(500, 512) if i != q][:10]
    assert hits / (10 * len(asked)) >= 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1.0, 2.0]), (8, [1.0, 3.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0]), (100, [1.0, 2.0])]
    vectors = frame(spark, rows)
    got = sorted(map(tuple, neighbours.nearest(vectors.filter("vec_id % 100 = 0"), vectors).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 8), (0, 3, 100), (0, 4, 100), (0, 5, 8), (100, 1, 8), (100, 2, 8), (100, 3, 0), (100, 4, 1)]
    assert neighbours.nearest(frame(spark, []), vectors).count() == 0
    assert neighbours.nearest(vectors, frame(spark, [])).count() == 0


def plain_repeats(rows, run_words):
    """Spans to remove, by direct search."""
    seen, found = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        for n, unit in enumerate(lines.units(rows[i][1] or "")):
            if unit[3] in seen:
                found.append((i, n, unit, seen[unit[3]]))
            else:
                seen[unit[3]] = rows[i][0]
    found.sort(key=lambda x: x[:2])
    out, run = [], []
    for x in [*found, (None, None, None, None)]:
        if run and (x[0] != run[-1][0] or x[1] != run[-1][1] + 1):
            words = sum(r[2][2] for r in run)
            if words >= run_words:
                out.append((rows[run[0][0]][0], run[0][2][0], run[-1][2][1], len(run), words, run[0][3]))
            run = []
        run.append(x)
    return sorted(out, key=repr)


def test_repeats_of_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r)[1:] for r in lines.repeated_units(docs).collect()), key=repr)
    assert got == plain_repeats(rows, lines.RUN_WORDS) and len(got) > 5


def test_units_keep_offsets():
    text = "Hello there, my dear old friend!  Yes. No. Well (as said) it is fine.\nHELLO there my DEAR old friend\n\n?? !\nend"
    found = [(text[a:b], n) for a, b, n, _ in lines.units(text)]
    assert found == [("Hello there, my dear old friend!  ", 6), ("Yes. No. Well (as said) it is fine.", 8), ("HELLO there my DEAR old friend", 6), ("end", 1)]
    digests = [d for *_, d in lines.units(text)]
    assert digests[0] == digests[2] and len(set(digests)) == 3


def test_odd_rows_of_lines(documents, odd, spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [*odd, (70, f"Start here now my friend. {long}. End."), (60, f"x\n{long}"), (61, long.upper() + "!"), (62, "other words"), (60, f"x\n{long}")]
    got = sorted((tuple(r)[1:] for r in lines.repeated_units(documents(rows).coalesce(1)).collect()), key=repr)
    assert got == plain_repeats(rows, lines.RUN_WORDS)
    assert {g[0] for g in got} >= {60, 61, 70} and 62 not in {g[0] for g in got}
    assert lines.repeated_units(documents([])).count() == 0
