"""The driver tables seen as question bank, answer log, cards and reviews.

Every view covers its whole source table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRECT_EVENTS = ["view", "click", "purchase"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per part; parts up to size 25 belong to the exam of their brand."""
    part = table(spark, sf_dir, "part")
    in_exam = F.col("p_size") <= 25
    return part.select(
        F.col("p_partkey").alias("question_id"),
        F.col("p_partkey").cast("string").alias("question_number"),
        F.col("p_type").alias("topic"),
        F.col("p_name").alias("question_text"),
        F.when(in_exam, F.col("p_brand")).alias("reconstruction_name"),
        F.when(in_exam, F.col("p_partkey")).alias("reconstruction_order"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per event; ``k`` in the properties is the question."""
    return answers_from_events(table(spark, sf_dir, "events"))


def answers_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("username"),
        F.get_json_object("props", "$.k").cast("bigint").alias("question_id"),
        F.col("event_type").isin(CORRECT_EVENTS).alias("is_correct"),
        F.col("ts").alias("answered_at"),
    )


def dense(answers: DataFrame) -> DataFrame:
    """The same answers on ten questions, so that histories get long."""
    return answers.withColumn("question_id", F.col("question_id") % 10)


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was shown to whom: the ``view`` events."""
    return impressions_from_events(table(spark, sf_dir, "events"))


def impressions_from_events(events: DataFrame) -> DataFrame:
    return answers_from_events(events.where(F.col("event_type") == "view")).select(
        "id", "username", "question_id", F.col("answered_at").alias("shown_at")
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text bank: one question per document; French and German have a topic of their own."""
    documents = table(spark, sf_dir, "documents")
    own_topic = F.when(F.col("lang").isin("fr", "de"), F.col("lang")).otherwise("")
    return documents.select(
        F.col("doc_id").alias("question_id"),
        F.col("text").alias("question_text"),
        F.col("source").alias("source_file"),
        F.col("lang").alias("source_type"),
        F.col("doc_id").alias("ordinal"),
        own_topic.alias("topic"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.col("doc_id").alias("question_id"),
        F.concat(F.lit("h"), F.col("quality").cast("string")).alias("topic"),
        F.col("doc_id").alias("ordinal"),
    )


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made overrides: the documents labelled toxic."""
    labels = table(spark, sf_dir, "labels")
    return labels.where(F.col("toxic") == 1).select(
        F.col("doc_id").alias("question_id"),
        F.concat(F.lit("m"), F.col("quality").cast("string")).alias("topic"),
        F.col("doc_id").alias("ordinal"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it; long fronts are archived."""
    turns = table(spark, sf_dir, "conversations")
    front = turns.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("id"), F.col("text").alias("front_text")
    )
    back = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("id"), F.col("text").alias("back_text")
    )
    return front.join(back, ["conv_id", "id"]).select(
        F.col("conv_id").alias("username"),
        "id",
        "front_text",
        "back_text",
        F.lit(None).cast("string").alias("topic"),
        (F.length("front_text") > 150).alias("archived"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("username"),
        F.get_json_object("props", "$.k").alias("card_id"),
        F.when(F.col("event_type") == "purchase", "correct").otherwise("again").alias("rating"),
        F.col("ts").alias("reviewed_at"),
    )
