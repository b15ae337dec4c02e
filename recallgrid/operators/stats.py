"""Answer-log and bank statistics, for all learners in one job."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.scoring import confidence_band, count_true, percent


def user_totals(answers: DataFrame) -> DataFrame:
    """Answers, correct answers and accuracy per learner."""
    return (
        answers.groupBy("username")
        .agg(
            F.count(F.lit(1)).alias("total_answered"),
            count_true(F.col("is_correct")).alias("total_correct"),
        )
        .withColumn("accuracy", percent(F.col("total_correct"), F.col("total_answered")))
    )


def attempts_per_question(answers: DataFrame) -> DataFrame:
    """Attempts and correct attempts per (learner, question).

    Every report that joins answers with questions starts here: the partial
    aggregation shrinks the log before it is shuffled, and afterwards no
    single answer row of a busy question travels on its own.
    """
    return answers.groupBy("username", "question_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        count_true(F.col("is_correct")).alias("correct"),
    )


def topic_stats(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Accuracy by attempts per learner and topic, worst topic first."""
    topics = questions.select("question_id", "topic")
    return (
        attempts_per_question(answers)
        .join(topics, "question_id")
        .groupBy("username", "topic")
        .agg(F.sum("attempts").alias("total"), F.sum("correct").alias("correct"))
        .withColumn("accuracy", percent(F.col("correct"), F.col("total")))
        .orderBy("username", "accuracy", "topic")
    )


def topic_performance(performance: DataFrame) -> DataFrame:
    """Questions, attempts and accuracy over all attempts per learner and topic."""
    return (
        performance.groupBy("username", "topic")
        .agg(
            F.count(F.lit(1)).alias("questions_answered"),
            F.sum("correct_attempts").alias("total_correct"),
            F.sum("total_attempts").alias("total_attempts"),
            F.avg("priority_score").alias("avg_priority"),
        )
        .withColumn("accuracy", percent(F.col("total_correct"), F.col("total_attempts")))
    )


def hardest_questions(
    answers: DataFrame, questions: DataFrame, min_attempts: int = 5, limit: int = 20
) -> DataFrame:
    """The questions with the highest error rate among those asked often enough."""
    per_question = (
        answers.groupBy("question_id")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            count_true(~F.col("is_correct")).alias("errors"),
        )
        .where(F.col("attempts") > min_attempts)
    )
    # Decimal division keeps ties of the one-decimal rounding exact.
    exact = F.col("errors").cast("decimal(19,0)") * 100 / F.col("attempts").cast("decimal(19,0)")
    return (
        per_question.join(questions.select("question_id", "question_number", "topic"), "question_id")
        .withColumn("error_rate", F.round(exact, 1).cast("double"))
        .orderBy(F.desc("error_rate"), "question_id")
        .limit(limit)
    )


def review_totals(reviews: DataFrame) -> DataFrame:
    """Flashcard reviews and those rated correct per learner."""
    return reviews.groupBy("username").agg(
        F.count(F.lit(1)).alias("total_reviewed"),
        count_true(F.col("rating") == "correct").alias("correct_count"),
    )


def bank_counts(questions: DataFrame) -> DataFrame:
    """Rows of the bank and rows with at least one image."""
    return questions.agg(
        F.count(F.lit(1)).alias("questions"),
        count_true(F.size("images") > 0).alias("with_images"),
    )


def answered_questions(answers: DataFrame) -> DataFrame:
    return answers.select("username", "question_id").distinct()


def learners(answers: DataFrame) -> DataFrame:
    return answers.select("username").distinct()


def exam_names(questions: DataFrame) -> DataFrame:
    named = questions.where(F.col("reconstruction_name").isNotNull())
    return named.select("reconstruction_name").distinct().orderBy("reconstruction_name")


def distribution(frame: DataFrame, value: Column | str, bar: str = "#") -> DataFrame:
    """Count, share and text bar per value, most frequent first."""
    value = F.col(value) if isinstance(value, str) else value
    counts = frame.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.withColumn("pct", percent(F.col("n"), total))
        .withColumn("bar", F.repeat(F.lit(bar), F.floor(F.col("pct") / 2).cast("int")))
        .orderBy(F.desc("n"), "value")
    )


def category_summary(classified: DataFrame) -> DataFrame:
    """Questions, share, mean confidence and confidence band per category."""
    groups = classified.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence")
    )
    total = groups.agg(F.sum("n")).scalar()
    return (
        groups.withColumn("pct", percent(F.col("n"), total))
        .withColumn("band", confidence_band(F.col("avg_confidence")))
        .orderBy(F.desc("n"), "category")
    )


def confidence_histogram(classified: DataFrame) -> DataFrame:
    """Questions per confidence band in one pass."""
    bands = classified.groupBy(confidence_band(F.col("confidence")).alias("band")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = bands.agg(F.sum("n")).scalar()
    return bands.withColumn("pct", percent(F.col("n"), total))


def extraction_profile(questions: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Everything the extraction summary prints, as rows (metric, key, value).

    One scan: each question is exploded to the metrics it counts for, and the
    partial aggregation folds them before anything is shuffled.
    """
    nothing = F.lit(None).cast("string")
    one = F.lit(1).cast("bigint")

    def entry(metric, key, value):
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.alias("value"))

    has_images = F.size("images") > 0
    in_exam = F.col("reconstruction_name").isNotNull() & (F.col("reconstruction_name") != "")
    entries = F.array(
        entry("questions", nothing, one),
        entry("with_images", nothing, F.when(has_images, one).otherwise(F.lit(0))),
        entry("image_urls", nothing, F.greatest(F.size("images"), F.lit(0)).cast("bigint")),
        entry("in_exams", nothing, F.when(in_exam, one).otherwise(F.lit(0))),
        entry("by_source_file", F.coalesce("source_file", F.lit("unknown")), one),
        F.when(in_exam, entry("by_exam", F.col("reconstruction_name"), one)),
    )
    counted = (
        questions.select(F.explode(F.array_compact(entries)).alias("e"))
        .groupBy("e.metric", "e.key")
        .agg(F.sum("e.value").alias("value"))
    )
    ids = questions.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    duplicates = ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("value")).select(
        F.lit("duplicate_ids").alias("metric"), nothing.alias("key"), "value"
    )
    out = counted.unionByName(duplicates)
    if issues is not None:
        codes = issues.groupBy(F.col("code").alias("key")).agg(F.count(F.lit(1)).alias("value"))
        out = out.unionByName(codes.select(F.lit("issues").alias("metric"), "key", "value"))
    return out
