"""Image URLs of questions: rewriting, migration status and storage names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.scoring import count_true
from recallgrid.functions.text import storage_name

# Part of every URL that already points to the image store.
HOSTED_MARKER = "hosted"


def is_hosted(url: Column, marker: str = HOSTED_MARKER) -> Column:
    return url.contains(marker)


def image_rows(questions: DataFrame) -> DataFrame:
    """One row per image: (question_id, pos, url)."""
    return questions.select("question_id", F.posexplode("images").alias("pos", "url"))


def classify_images(
    questions: DataFrame, image_map: DataFrame, marker: str = HOSTED_MARKER
) -> DataFrame:
    """Image rows with their new URL and what happened to them.

    The map may be as large as the bank, so it is joined, not collected; a URL
    used by very many questions is a skewed join key, which adaptive execution
    splits on the image side.
    """
    mapped = image_map.select(F.col("original_url").alias("url"), "hosted_url")
    status = (
        F.when(F.coalesce("url", F.lit("")) == "", "empty")
        .when(is_hosted(F.col("url"), marker), "already_hosted")
        .when(F.col("hosted_url").isNotNull(), "replaced")
        .otherwise("not_found")
    )
    return (
        image_rows(questions)
        .join(mapped, "url", "left")
        .withColumn("status", status)
        .withColumn("new_url", F.when(F.col("status") == "replaced", F.col("hosted_url")).otherwise(F.col("url")))
        .select("question_id", "pos", "url", "new_url", "status")
    )


def rewrite_images(
    questions: DataFrame, image_map: DataFrame, marker: str = HOSTED_MARKER
) -> DataFrame:
    """The questions with every mapped image URL replaced, order kept."""
    rebuilt = (
        classify_images(questions, image_map, marker)
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "new_url"))).alias("_images"))
    )
    images = F.coalesce(F.transform("_images", lambda i: i["new_url"]), F.array().cast("array<string>"))
    return questions.join(rebuilt, "question_id", "left").withColumn("images", images).drop("_images")


def rewrite_counters(classified: DataFrame) -> DataFrame:
    """total / replaced / not_found / already_hosted; empty URLs count only in total."""
    status = F.col("status")
    return classified.agg(
        F.count(F.lit(1)).alias("total_images"),
        count_true(status == "replaced").alias("replaced"),
        count_true(status == "not_found").alias("not_found"),
        count_true(status == "already_hosted").alias("already_hosted"),
    ).na.fill(0)


def migration_status(classified: DataFrame) -> DataFrame:
    """Non-empty image URLs by how far their migration is."""
    status = F.col("status")
    return classified.where(status != "empty").agg(
        F.count(F.lit(1)).alias("total"),
        count_true(status == "already_hosted").alias("already_hosted"),
        count_true(status == "replaced").alias("in_map"),
        count_true(status == "not_found").alias("pending"),
        count_true(status != "not_found").alias("migrated"),
    ).na.fill(0)


def pending_images(classified: DataFrame) -> DataFrame:
    """Images still to be moved, with the name each gets in the store; names count from 1."""
    name = storage_name(F.col("question_id"), F.col("pos") + 1, F.col("url"))
    return classified.where(F.col("status") == "not_found").select(
        "question_id", "pos", "url", name.alias("storage_name")
    )
