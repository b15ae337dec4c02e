"""Saved pages as a stream: any order of arrival gives the bank of all pages."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from recallgrid.plans import build_bank
from recallgrid.sources import readers
from recallgrid.streaming.pages import keep_pages, kept_questions
from recallgrid.streaming.state_table import StateTable
from test_tables import QUIZ

PAGES = {
    ("a", "01"): [(1, "Primera"), (2, "Segunda")],
    ("a", "02"): [(3, "Tercera"), (1, "Otra primera")],
    ("b", "01"): [(2, "Segunda tarde"), (4, "  PRIMERA")],
    ("b", "03"): [],
    ("c", "01"): [(5, "Quinta"), (5, "Quinta otra vez")],
}


def save(site, places):
    for folder, stem in places:
        (site / folder).mkdir(parents=True, exist_ok=True)
        content = "".join(QUIZ.format(n=n, text=text) for n, text in PAGES[folder, stem])
        (site / folder / f"{stem}.html").write_text(content or "<p>nada</p>")


def rows(frame):
    return sorted(frame.collect(), key=repr)


@pytest.mark.parametrize("prefix, most_parts", [(None, 1), ("exam", 1), ("exam", 8)])
def test_batches_in_any_order_give_the_bank_of_all(spark, tmp_path, prefix, most_parts):
    site, table, checkpoint = tmp_path / "site", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    site.mkdir()
    stream = readers.read_pages(spark, str(site), recursive=True, files_per_batch=1)
    source = build_bank.Source(stream, "quiz", "quiz", exam_prefix=prefix)
    # Three runs of the stream, the last folders first; the second run takes two batches or more.
    for arriving in ([("c", "01")], [("b", "03"), ("b", "01"), ("a", "02")], [("a", "01")]):
        save(site, arriving)
        keep_pages(source, table, checkpoint, most_parts=most_parts).awaitTermination()
    whole = replace(source, pages=readers.read_pages(spark, str(site), recursive=True))
    want, failed = build_bank.source_questions(whole)
    got, got_failed = kept_questions(spark, table, source)
    assert rows(got.select(want.columns)) == rows(want)
    # The ids 1 in folder a and 5 in folder c come twice, 2 also in two folders.
    assert want.count() == (6 if prefix else 5)
    assert got_failed.count() == failed.count() == 0
    kept = StateTable(spark, table)
    assert kept.manifest().batch == 4 and len(kept.manifest().parts) <= most_parts + 1
    before = kept.manifest()
    keep_pages(source, table, checkpoint).awaitTermination()
    assert kept.manifest() == before


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    site, table = tmp_path / "site", str(tmp_path / "table")
    save(site, PAGES)
    source = build_bank.Source(readers.read_pages(spark, str(site), recursive=True, files_per_batch=9), "quiz", "quiz")
    checkpoint = str(tmp_path / "checkpoint")
    keep_pages(source, table, checkpoint).awaitTermination()
    before = rows(kept_questions(spark, table, source)[0])
    # The commit of the batch is lost from the checkpoint, not from the table.
    for name in ("0", ".0.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    keep_pages(source, table, checkpoint).awaitTermination()
    assert StateTable(spark, table).manifest().version == 0
    assert rows(kept_questions(spark, table, source)[0]) == before


def test_near_duplicates_over_kept_sources(spark, tmp_path):
    found = []
    for prefix in ("exam", None):
        site, table = tmp_path / f"site-{prefix}", str(tmp_path / f"table-{prefix}")
        save(site, PAGES)
        stream = readers.read_pages(spark, str(site), recursive=True, files_per_batch=2)
        source = build_bank.Source(stream, "quiz", "quiz", exam_prefix=prefix)
        keep_pages(source, table, str(tmp_path / f"checkpoint-{prefix}")).awaitTermination()
        found.append(kept_questions(spark, table, source)[0])
    history = spark.createDataFrame([], "question_id string, topic string, ordinal bigint")
    bank = build_bank.bank_of(found, history, valid_topics=None)
    texts = [r[0] for r in bank.select(F.lower(F.trim("question_text"))).collect()]
    # Later questions of an id within its exam are gone, and with them their texts; the other PRIMERA is a near-duplicate.
    assert sorted(texts) == ["primera", "quinta", "segunda", "segunda tarde", "tercera"]
