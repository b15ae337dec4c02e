import random

from recallgrid.llm import language

SAY = {
    "en": ["the", "house", "thing", "with", "that"],
    "de": ["der", "ungleich", "schon", "nicht", "zwei"],
    "fi": ["talo", "kaikki", "hyvin", "minun", "olemme"],
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_a_language_of_one_document_is_a_candidate(spark):
    rng = random.Random(4)
    text = lambda x: " ".join(rng.choice(SAY[x]) for _ in range(40))
    rows = [(i, text(x), x, "s") for i, x in enumerate(["en", "de"] * 40)] + [(100, text("fi"), "fi", "s"), (101, text("fi"), None, "s"), (102, text("en"), None, "s")]
    got = {r.doc_id: r for r in language.identify(frame(spark, rows)).collect()}
    assert all(got[i].language == x and got[i].kept for i, _, x, _ in rows[:81])
    assert (got[101].language, got[102].language) == ("fi", "en") and got[101].kept and got[102].kept


def test_few_labels_reject_nothing(spark):
    few = [(i, " ".join(SAY[x] * 8), x, "s") for i, x in enumerate(["en", "de", "fi"])]
    assert [(r.language, r.kept) for r in sorted(language.identify(frame(spark, few)).collect())] == [("en", True), ("de", True), ("fi", True)]
    none = [(i, t, None, s) for i, t, _, s in few] + [(9, "12 !", None, "s")]
    assert {r.doc_id: r.kept for r in language.identify(frame(spark, none)).collect()} == {0: True, 1: True, 2: True, 9: False}
