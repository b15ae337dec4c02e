"""Unions of sources and de-duplication that keeps the first row."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.text import prefix_key


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Stack the sources; ``source_rank`` remembers their order."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def keep_first(frame: DataFrame, key: Column | str, order: list[str]) -> DataFrame:
    """The first row per key in the given order.

    ``row_number() = 1`` lets Spark drop all but one row of a key in every
    input partition before the shuffle, so many copies of one text do no harm.
    """
    key = F.col(key) if isinstance(key, str) else key
    first = Window.partitionBy("_key").orderBy(*order)
    return (
        frame.withColumn("_key", key)
        .withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") == 1)
        .drop("_key", "_place")
    )


def drop_text_duplicates(
    frame: DataFrame, text: str = "question_text", order: list[str] | None = None
) -> DataFrame:
    """Near-duplicates by the start of the text; the earliest source wins."""
    return keep_first(frame, prefix_key(F.col(text)), order or ["source_rank", "ordinal"])


def duplicate_report(frame: DataFrame, key: str = "question_id") -> DataFrame:
    """Every later row of a repeated key with the file of its first row.

    First rows come from an aggregation, not from a window over the key, so a
    key that fills a third of the table is still spread over many tasks.
    """
    firsts = (
        frame.groupBy(key)
        .agg(
            F.min_by("source_file", "ordinal").alias("first_source"),
            F.min("ordinal").alias("first_ordinal"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("n") > 1)
        .drop("n")
    )
    return (
        frame.join(firsts, key)
        .where(F.col("ordinal") > F.col("first_ordinal"))
        .select(
            key,
            "first_ordinal",
            "first_source",
            F.col("ordinal").alias("duplicate_ordinal"),
            F.col("source_file").alias("duplicate_source"),
        )
    )
