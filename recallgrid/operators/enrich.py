"""Topic enrichment from lookup tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid import schemas as S
from recallgrid.functions.text import strip


def last_per_key(lookup: DataFrame) -> DataFrame:
    """One topic per question; of repeated keys the last one counts."""
    return lookup.groupBy("question_id").agg(
        F.max_by("topic", "ordinal").alias("topic")
    )


def merge_topics(
    bank: DataFrame,
    history: DataFrame,
    manual: DataFrame | None = None,
    blank_history_matches: bool = True,
) -> DataFrame:
    """Own topic, else manual, else historical, else unclassified.

    Adds ``topic_source``. Lookups are joined on the question id; Spark
    broadcasts them only when their measured size allows it. With
    ``blank_history_matches=False`` an empty historical topic does not count.
    """
    own = F.coalesce(strip(F.col("topic")), F.lit(""))
    past = last_per_key(history)
    if not blank_history_matches:
        past = past.where(F.col("topic") != "")
    past = past.select("question_id", F.col("topic").alias("_past"), F.lit(True).alias("_in_past"))
    out = bank.join(past, "question_id", "left")
    has_manual = F.lit(False)
    manual_topic = F.lit(None).cast("string")
    if manual is not None:
        hand = last_per_key(manual).select(
            "question_id", F.col("topic").alias("_hand"), F.lit(True).alias("_in_hand")
        )
        out = out.join(hand, "question_id", "left")
        has_manual, manual_topic = F.col("_in_hand"), F.col("_hand")
    source = (
        F.when(own != "", "already_had_topic")
        .when(has_manual, "matched_from_manual")
        .when(F.col("_in_past"), "matched_from_historical")
        .otherwise("still_unclassified")
    )
    topic = (
        F.when(own != "", F.col("topic"))
        .when(has_manual, manual_topic)
        .when(F.col("_in_past"), F.col("_past"))
        .otherwise(F.lit(S.UNCLASSIFIED))
    )
    return (
        out.withColumn("topic_source", source)
        .withColumn("topic", topic)
        .drop("_past", "_in_past", "_hand", "_in_hand")
    )


def merge_counters(merged: DataFrame) -> DataFrame:
    return merged.groupBy("topic_source").agg(F.count(F.lit(1)).alias("n"))


def invalid_topics(frame: DataFrame, valid: list[str] = S.VALID_TOPICS) -> DataFrame:
    """Rows whose non-blank topic is not in the list; must be empty to go on."""
    topic = strip(F.col("topic"))
    return frame.where((topic != "") & ~topic.isin(valid))


def unclassified_report(merged: DataFrame) -> DataFrame:
    """Questions still without a topic: id, start of the text and source type."""
    return merged.where(F.col("topic_source") == "still_unclassified").select(
        "question_id",
        F.substring("question_text", 1, S.PREFIX_LENGTH).alias("question_text"),
        "source_type",
    )
