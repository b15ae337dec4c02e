"""Queries for tables that are kept current: late answers, totals by differences, changes by bucket, jobs in slices, pages as they are saved."""

import datetime
from dataclasses import replace

from pyspark.sql import functions as F

from recallgrid.operators import classify, maintenance
from recallgrid.plans import build_bank, derived
from recallgrid.plans import fixtures as X
from recallgrid.plans.catalog import _arriving, _build_sources, _card_edits, query, rounded
from recallgrid.plans.oracles import ORACLES, sql
from recallgrid.sources.keyed_table import KeyedTable
from recallgrid.sources.resumable import ResumableTable
from recallgrid.sources.storage import new_path, stored
from recallgrid.streaming import pages, reports
from recallgrid.streaming.answer_tree import AnswerTree

# --- Late answers --------------------------------------------------------------


def _late_tree(spark, sf):
    """Four batches whose days come in no order, a third of each day's answers with another batch than the rest."""
    log = X.answers(spark, sf)
    batch = (F.dayofyear("answered_at") * 7 + F.when(F.col("id") % 3 == 0, 1).otherwise(0)) % 4
    arrived = stored(log.withColumn("batch", batch), "arriving")
    tree = AnswerTree(spark, new_path(spark, "answer-tree"), log.schema)
    for number in range(4):
        tree.add(arrived.where(F.col("batch") == number).drop("batch"), number, "log")
    return tree


@query
def learner_state_late(spark, sf):
    """A1 with late answers: the tree's state equals the fold of the whole log."""
    return _late_tree(spark, sf).state(X.questions(spark, sf))


ORACLES["learner_state_late"] = sql(["perf"], "SELECT * FROM perf")


@query
def learner_state_before(spark, sf):
    """The state before a day, out of the tree."""
    return _late_tree(spark, sf).state_before(datetime.date(2024, 1, 20), X.questions(spark, sf))


ORACLES["learner_state_before"] = ORACLES["learner_state_late"].replace(
    "FROM events", "FROM events WHERE ts < TIMESTAMP '2024-01-20'", 1
)


# --- Totals kept by differences ------------------------------------------------


def _kept_reports(spark, sf):
    log = X.answers_from_events(_arriving(spark, sf, "events", 4))
    path = new_path(spark, "reports")
    reports.keep_reports(log, X.questions(spark, sf), path, new_path(spark, "reports-checkpoint"), buckets=16).awaitTermination()
    return path


@query
def learner_totals_kept(spark, sf):
    """A2 after four micro-batches."""
    return rounded(reports.user_totals(spark, _kept_reports(spark, sf)), "accuracy")


@query
def accuracy_by_topic_kept(spark, sf):
    """A3 after four micro-batches."""
    return rounded(reports.topic_stats(spark, _kept_reports(spark, sf)), "accuracy")


@query
def topic_performance_kept(spark, sf):
    """A4 after four micro-batches: answers of one key in several of them count it once."""
    return rounded(reports.topic_performance(spark, _kept_reports(spark, sf)), "avg_priority", "accuracy")


@query
def exam_progress_kept(spark, sf):
    """A7, A8 after four micro-batches."""
    return rounded(reports.exam_progress(spark, _kept_reports(spark, sf), X.questions(spark, sf)), "accuracy", "progress")


for _name in ("learner_totals", "accuracy_by_topic", "topic_performance", "exam_progress"):
    ORACLES[f"{_name}_kept"] = ORACLES[_name]


# --- Changes by bucket -----------------------------------------------------------


def _table(spark, rows, name, by):
    table = KeyedTable(spark, new_path(spark, name), rows.schema, by, buckets=32)
    table.load(rows)
    return table


@query
def bank_upsert_in_buckets(spark, sf):
    """K1: the changes of bank_upsert on a stored table."""
    table = _table(spark, derived.stored_bank(spark, sf), "bank", ["question_id"])
    table.upsert(derived.changed_questions(spark, sf), derived.at(derived.CHANGED_AT), "ordinal")
    same = (F.col("updated_at") == F.col("created_at")).alias("is_new_or_untouched")
    return table.rows().select("question_id", "topic", "question_text", same)


ORACLES["bank_upsert_in_buckets"] = ORACLES["bank_upsert"]


@query
def cards_inserted_in_buckets(spark, sf):
    """K2: all cards offered to the active ones; the table afterwards."""
    cards = X.cards(spark, sf)
    table = _table(spark, maintenance.active_cards(cards), "cards", ["username"])
    table.insert_new(cards, ["username", "front_text"], ["id"])
    return table.rows().select("username", "id", "front_text")


ORACLES["cards_inserted_in_buckets"] = (
    f"SELECT username, id, front_text FROM ({ORACLES['active_cards']}) UNION ALL "
    f"SELECT username, id, front_text FROM ({ORACLES['cards_inserted']}) JOIN "
    "(SELECT conv_id AS username, turn AS id, text AS front_text FROM conversations WHERE role = 'user') USING (username, id) "
    "WHERE outcome = 'inserted'"
)


@query
def cards_updated_in_buckets(spark, sf):
    """K3: the edits of cards_updated on a stored table."""
    cards = X.cards(spark, sf)
    table = _table(spark, cards, "cards", ["username"])
    table.update_cards(_card_edits(cards), ["username", "id"])
    return table.rows()


ORACLES["cards_updated_in_buckets"] = ORACLES["cards_updated"]


@query
def cards_archived_in_buckets(spark, sf):
    """K4 on a stored table."""
    cards = X.cards(spark, sf)
    table = _table(spark, cards, "cards", ["username"])
    table.archive_cards(cards.where(F.length("back_text") > 400).select("username", "id"), ["username", "id"])
    return table.rows().select("username", "id", "archived")


ORACLES["cards_archived_in_buckets"] = ORACLES["cards_archived"]


@query
def answers_purged_in_buckets(spark, sf):
    """K5: learners whose last answer was wrong lose their answers."""
    log = X.answers(spark, sf)
    table = _table(spark, log, "answers", ["username"])
    last = log.groupBy("username").agg(F.max_by("is_correct", F.struct("answered_at", "id")).alias("right"))
    table.remove(last.where(~F.col("right")).select("username"))
    return table.rows().groupBy("username").agg(F.count(F.lit(1)).alias("n"))


ORACLES["answers_purged_in_buckets"] = sql(
    ["answers"],
    """SELECT username, count(*) AS n FROM answers GROUP BY username
       HAVING last(is_correct ORDER BY answered_at, id)""",
)


# --- Jobs in slices --------------------------------------------------------------


@query
def classified_resumed(spark, sf):
    """K7: the answers of a classifier, parsed in a job that ends after one group of slices and is run again."""
    responses = stored(derived.responses(spark, sf), "responses")
    parsed = classify.parse_responses(responses).schema
    job = ResumableTable(spark, new_path(spark, "classified"), parsed, ["question_id"], 8)
    for most_groups in (1, None):
        job.run(responses, classify.parse_responses, at_once=4, most_groups=most_groups)
    return rounded(job.accepted(), "confidence")


ORACLES["classified_resumed"] = ORACLES["classified_responses"]


def _checked_import(spark, sf):
    raw = stored(derived.raw_questions(spark, sf), "raw-questions")
    path = new_path(spark, "checked-import")
    build_bank.checked_in_slices(raw, path, 8, 4, most_groups=1)
    return build_bank.checked_in_slices(raw, path, 8, 4)


@query
def import_in_slices(spark, sf):
    """What each question of an import in two runs came to."""
    job = _checked_import(spark, sf)
    ok, bad = (side.select("question_id", F.size("issues").alias("n_issues")) for side in (job.accepted(), job.quarantine()))
    return ok.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


ORACLES["import_in_slices"] = f"""
    WITH f AS (SELECT question_id, count(*) AS n FROM ({ORACLES["import_findings"]}) GROUP BY question_id)
    SELECT doc_id AS question_id, CAST(coalesce(f.n, 0) AS INT) AS n_issues, f.n IS NULL AS accepted
    FROM documents LEFT JOIN f ON f.question_id = doc_id"""


@query
def import_ledger(spark, sf):
    """Accepted and rejected rows of the import by its ledger."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return _checked_import(spark, sf).ledger().agg(total("n_in"), total("n_accepted"), total("n_rejected"), F.count("error").alias("n_failed"))


ORACLES["import_ledger"] = f"""
    SELECT valid + invalid AS n_in, valid AS n_accepted, invalid AS n_rejected, 0::BIGINT AS n_failed FROM ({ORACLES["import_report"]})"""


# --- Pages as they are saved -------------------------------------------------------


@query
def bank_from_page_stream(spark, sf):
    """The pages of each source arrive in three batches, the bank is that of all pages."""
    questions = []
    for rank, source in enumerate(_build_sources(spark, sf)):
        folder, table = new_path(spark, "pages"), new_path(spark, "page-questions")
        # Batches cut across folders, and a batch holds later pages of a folder than the next one.
        source.pages.repartition(3, F.xxhash64("stem")).write.parquet(folder)
        arriving = spark.readStream.schema(source.pages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        streamed = replace(source, pages=arriving)
        pages.keep_pages(streamed, table, new_path(spark, "pages-checkpoint"), most_parts=1 + rank).awaitTermination()
        questions.append(pages.kept_questions(spark, table, streamed)[0])
    no_history = spark.createDataFrame([], "question_id string, topic string, ordinal bigint")
    bank = build_bank.bank_of(questions, no_history, valid_topics=None)
    return bank.select("question_id", "question_text", "topic", "topic_source", "source_type", "source_file")


ORACLES["bank_from_page_stream"] = ORACLES["bank_from_pages"]
