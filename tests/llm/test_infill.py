import hashlib
import random
import re

import duckdb
import pytest

from recallgrid.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain(doc, text):
    """The contract, read literally."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MARKS = ["a<P>b", "<S>", "x <M", "<P", "<", "<<S", "P>", "M> <", "<p>", "S><P", "><M"]


def test_odd_texts(spark, documents, odd):
    rows = odd + [(100 + i, x * (1 + i % 3)) for i, x in enumerate(MARKS)]
    rows += [(1000 + i, random.Random(i).choice(MARKS[2:]) * 2 + "né<" * i) for i in range(300)]
    out = infill.rearranged(documents(rows))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted((plain(i, t) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = infill.restored(out).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_whole_table_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.collect():
        *head, output = plain(r.doc_id, r.text)
        want.append((*head, sha(output), sha(r.text or "")))
    assert sorted(map(tuple, infill.digests(docs).collect())) == sorted(want)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(con.sql(infill.ORACLE).fetchall()) == sorted(want)


@pytest.mark.parametrize("size", [1, infill.BLOCK - 1, infill.BLOCK, infill.BLOCK + 1, 300 * infill.BLOCK + 7])
def test_borders_of_many_blocks(size):
    rng = random.Random(size)
    text = "".join(rng.choice(["word", "é", " ", "日", "\U0001f600", "Zz", "1"]) for _ in range(size))[:size]
    text = text[: size // 2] + "w" * (3 * infill.BLOCK) + text[size // 2 :]
    data = text.encode()
    tree = infill.BlockTree(data)
    starts = [m.start() for m in UNIT.finditer(text)] + [len(text)]
    assert tree.units == len(starts) - 1 and tree.points == len(text)
    for unit in {0, 1, len(starts) // 2, len(starts) - 2, len(starts) - 1, *(rng.randrange(len(starts)) for _ in range(20))}:
        at, points = tree.border(unit)
        assert points == starts[unit] and data[:at].decode() == text[:points]


def test_epochs_differ_and_empty_table(spark, documents):
    rows = [(i, "some words, and others. " * 9) for i in range(50)]
    one, two = ({r.doc_id: r.output for r in infill.rearranged(documents(rows), e).collect()} for e in (1, 2))
    assert sum(one[i] != two[i] for i in one) > 40
    assert infill.digests(documents(rows).limit(0)).count() == 0
