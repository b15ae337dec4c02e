"""Mock exams: questions in exam order and each learner's progress."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.scoring import percent
from recallgrid.operators.running import total_before
from recallgrid.operators.complete import with_every
from recallgrid.operators.stats import attempts_per_question, learners


def exam_questions(questions: DataFrame, name: str | None = None) -> DataFrame:
    """Questions in exam order; all exams at once unless one is named."""
    if name is not None:
        return questions.where(F.col("reconstruction_name") == name).orderBy("reconstruction_order")
    return questions.where(F.col("reconstruction_name").isNotNull()).orderBy(
        "reconstruction_name", "reconstruction_order"
    )


def exam_totals(questions: DataFrame) -> DataFrame:
    return (
        questions.where(F.col("reconstruction_name").isNotNull())
        .groupBy(F.col("reconstruction_name").alias("name"))
        .agg(F.count(F.lit(1)).alias("total"))
    )


def exam_progress(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Progress per (learner, exam) with at least one answer.

    ``accuracy`` divides correct *attempts* by answered *questions*, so repeated
    correct answers take it over 100; that is the definition, not an error.
    """
    in_exam = questions.where(F.col("reconstruction_name").isNotNull()).select(
        "question_id", F.col("reconstruction_name").alias("name")
    )
    # One row per (learner, question), so counting rows counts questions.
    done = (
        attempts_per_question(answers)
        .join(in_exam, "question_id")
        .groupBy("username", "name")
        .agg(F.count(F.lit(1)).alias("answered"), F.sum("correct").alias("correct"))
    )
    return rates(done.join(exam_totals(questions), "name"))


def exam_progress_all(answers: DataFrame, questions: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Progress per learner and exam, untouched exams included with zeros.

    Without ``users`` the report is for all learners of the log.
    """
    done = exam_progress(answers, questions).select("username", "name", "answered", "correct")
    spine = with_every(learners(answers) if users is None else users, exam_totals(questions))
    filled = spine.join(done, ["username", "name"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("answered", "correct")}
    )
    return rates(filled).orderBy("username", "name")


def exam_progress_of(answers: DataFrame, questions: DataFrame, user) -> DataFrame:
    """All exams for one learner."""
    mine = exam_progress(answers.where(F.col("username") == F.lit(user)), questions)
    done = mine.select("name", "answered", "correct")
    filled = exam_totals(questions).join(done, "name", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("answered", "correct")}
    )
    return rates(filled.withColumn("username", F.lit(user))).orderBy("name")


def rates(frame: DataFrame) -> DataFrame:
    return frame.select(
        "username",
        "name",
        "total",
        "answered",
        "correct",
        percent(F.col("correct"), F.col("answered")).alias("accuracy"),
        percent(F.col("answered"), F.col("total")).alias("progress"),
    )


def number_exam(items: DataFrame, keep_collisions: bool = False) -> DataFrame:
    """Position of each item in its exam, over all files of the exam.

    ``items`` has reconstruction_name, stem, idx (place in its file) and parsed.
    By default positions have no gaps. With ``keep_collisions`` a file starts
    after the *parsed* items of earlier files while places in it count all
    items, so numbers may repeat, as in the original numbering.
    Offsets come from one row per file; only a file's own items share a window.
    """
    per_file = items.groupBy("reconstruction_name", "stem").agg(
        F.sum(F.when(F.col("parsed"), 1).otherwise(0)).alias("n_parsed")
    )
    offsets = total_before(per_file, ["reconstruction_name"], ["stem"], "n_parsed", "offset").drop(
        "n_parsed"
    )
    parsed = items.where("parsed").join(offsets, ["reconstruction_name", "stem"])
    if keep_collisions:
        place = F.col("idx") + 1
    else:
        place = F.row_number().over(
            Window.partitionBy("reconstruction_name", "stem").orderBy("idx")
        )
    return parsed.withColumn(
        "reconstruction_order", (F.col("offset") + place).cast("bigint")
    ).drop("offset", "parsed")
