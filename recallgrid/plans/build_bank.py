"""From saved pages to an importable question bank, and from there to the table.

Both jobs return DataFrames; only the checks that must stop a job run actions.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid import schemas as S
from recallgrid.operators import dedup, enrich, exams, html_items, images, maintenance, quality
from recallgrid.sources.resumable import SLICES, ResumableTable
from recallgrid.sources.storage import stored

COLUMNS = [f.name for f in S.QUESTION_FILE]


@dataclass
class Source:
    """Saved pages of one origin, in the order of preference for duplicates.

    ``pages`` has folder, stem, source_file and html. ``by_folder`` prefixes the
    ids by the folder (course modules); ``exam_prefix`` marks mock exams, whose
    folder is the exam name.
    """

    pages: DataFrame
    layout: str
    source_type: str
    by_folder: bool = False
    exam_prefix: str | None = None


def items_of(raw: DataFrame, source: Source) -> DataFrame:
    """Questions of the parsed pages of a source, before the numbering of exams; without the pages that failed."""
    if source.layout == "accordion":
        items = html_items.card_questions(raw, F.col("folder") if source.by_folder else None)
        return items if source.by_folder else items.withColumn("topic", F.lit(""))
    if source.exam_prefix is None:
        return html_items.quiz_questions(raw)
    return html_items.exam_quiz_questions(raw)


def first_questions(items: DataFrame, source: Source) -> DataFrame:
    """The first question of each id, with its place in the source; exams are numbered over all their pages."""
    if source.exam_prefix is None:
        found = items.where("parsed").withColumns(
            {
                "source_type": F.lit(source.source_type),
                "reconstruction_name": F.lit(None).cast("string"),
                "reconstruction_order": F.lit(None).cast("bigint"),
            }
        )
    else:
        named = items.withColumn("reconstruction_name", F.col("folder"))
        found = html_items.as_exam(
            exams.number_exam(named), source.exam_prefix, source.source_type
        )
    ordered = found.select(*COLUMNS, "folder", "stem", "idx")
    return dedup.keep_first(ordered, "question_id", ["folder", "stem", "idx"])


def source_questions(source: Source) -> tuple[DataFrame, DataFrame]:
    """Questions of one source, first of each id, and the pages that failed."""
    # Parsing is the only Python step; both results and the numbering read it.
    raw = stored(html_items.raw_items(source.pages, source.layout), "raw-items")
    return first_questions(items_of(raw, source), source), html_items.failed_pages(raw)


def build_bank(
    sources: list[Source],
    history: DataFrame,
    manual: DataFrame | None = None,
    valid_topics: list[str] | None = S.VALID_TOPICS,
) -> DataFrame:
    """All sources, without near-duplicates, each question with a topic."""
    return bank_of([source_questions(s)[0] for s in sources], history, manual, valid_topics)


def bank_of(
    questions: list[DataFrame],
    history: DataFrame,
    manual: DataFrame | None = None,
    valid_topics: list[str] | None = S.VALID_TOPICS,
) -> DataFrame:
    """The bank of the questions of each source, in order of preference."""
    united = dedup.union_sources(questions)
    order = ["source_rank", "folder", "stem", "idx"]
    unique = dedup.drop_text_duplicates(united, order=order).drop("folder", "stem", "idx")
    if valid_topics is not None:
        unique = stored(unique, "unique-questions")
        quality.require_none(
            enrich.invalid_topics(unique, valid_topics).select("question_id", "topic"),
            "questions with a topic outside the list",
        )
    return enrich.merge_topics(unique, history, manual, blank_history_matches=False)


def import_bank(
    raw: DataFrame,
    table: DataFrame,
    image_map: DataFrame,
    now: Column,
    update: bool = False,
    marker: str = images.HOSTED_MARKER,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw JSON questions into the stored bank.

    ``raw`` has question_id, json, ordinal and source_file. Repeated ids stop
    the job; then, unless ``update``, known questions are skipped; the rest is
    validated and its image URLs are replaced. Returns the new table content,
    the quarantine and the report.
    """
    quality.require_none(dedup.duplicate_report(raw), "duplicate question ids", shown=10)
    fresh = raw if update else maintenance.missing_from(raw, table)
    typed = F.from_json("json", S.QUESTION_FILE)
    checked = stored(
        quality.check_for_import(fresh).withColumn("q", typed).select("question_id", "json", "issues", "q"),
        "checked-questions",
    )
    valid, quarantine = quality.split_valid(checked)
    report = quality.import_report(
        checked.select("issues", "q.images", "q.reconstruction_name")
    ).withColumn("skipped", _count(raw) - _count(fresh))
    questions = valid.select("q.*").withColumn(
        "images", F.coalesce("images", F.array().cast("array<string>"))
    )
    ready = images.rewrite_images(questions, image_map, marker)
    return maintenance.upsert(table, ready, now), quarantine, report


def checked_in_slices(
    raw: DataFrame, path: str, slices: int = SLICES, at_once: int = 16, most_groups: int | None = None
) -> ResumableTable:
    """Raw JSON questions checked and published slice by slice in the folder; calling it again does the rest.

    Of the returned table ``accepted`` holds the questions (``q``), ``quarantine``
    those with findings, and ``ledger`` the counts of each slice.
    """

    def work(rows: DataFrame) -> DataFrame:
        checked = quality.check_for_import(rows.select("question_id", "json"))
        return checked.withColumn("q", F.from_json("json", S.QUESTION_FILE)).select("question_id", "json", "issues", "q")

    job = ResumableTable(raw.sparkSession, path, work(raw).schema, ["question_id"], slices)
    job.run(raw, work, F.size("issues") > 0, at_once, most_groups)
    return job


def _count(frame: DataFrame) -> Column:
    return frame.agg(F.count(F.lit(1))).scalar()
