from recallgrid.llm import lines


def test_short_repeats_are_returned(spark, documents):
    sentence, licence = "This sentence has come before in other texts too. ", "All rights reserved by the authors."
    rows = [(1, sentence + "First text of all here."), (2, "Another text begins like this. " + sentence), (3, licence), (4, licence),
            (5, "中文段落没有空格"), (6, "x y\n中文段落没有空格")]
    got = sorted((r.doc_id, rows[r.doc_id - 1][1][r.start : r.end], r.n_units, r.n_words, r.keeper_doc_id) for r in lines.repeated_units(documents(rows)).collect())
    assert got == [(2, sentence, 1, 9, 1), (4, licence, 1, 6, 3), (6, "中文段落没有空格", 1, 1, 5)]
