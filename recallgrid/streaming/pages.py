"""Saved pages as a stream: each page is parsed once, the bank is that of all pages.

A micro-batch of pages is parsed and leaves the first question of each id as a
further part of a ``StateTable``. The first of an id over all pages is among
the firsts of the batches, whatever order they arrive in, so a merge keeps the
first of the firsts and the table holds one row per id in each of a few parts.
Questions of exams are kept by their place, because their numbers, and with
them their ids, depend on the pages still to come. Near-duplicates over
sources are left out when the bank is read: that reads the kept rows, no page.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallgrid.operators import dedup, html_items
from recallgrid.plans.build_bank import Source, first_questions, items_of
from recallgrid.streaming.answers import MOST_PARTS
from recallgrid.streaming.state_table import StateTable

_PLACE = ["folder", "stem", "idx"]


def _firsts(rows: DataFrame, source: Source) -> DataFrame:
    """One row per id; of exams, and of pages that failed, one per place. The earliest arrival of a place counts."""
    by_id = F.lit(source.exam_prefix is None) & F.col("error").isNull()
    key = F.struct(F.when(by_id, F.col("question_id")).alias("id"), F.when(~by_id, F.struct(*_PLACE)).alias("place"), by_id.alias("by_id"))
    return dedup.keep_first(rows, key, [*_PLACE, "arrived"])


def keep_pages(
    source: Source,
    table: str,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "1 minute",
    most_parts: int = MOST_PARTS,
) -> StreamingQuery:
    """Start the stream that keeps the questions of a source whose ``pages`` are a stream.

    A page counts as it was when it first arrived; a file stream reads a path once.
    """

    def store(batch: DataFrame, number: int) -> None:
        # Questions and failed pages come of one parse; blocks that are lost are parsed again.
        raw = html_items.raw_items(batch, source.layout).persist()
        try:
            questions = items_of(raw, source).where("parsed").drop("parsed").withColumn("error", F.lit(None).cast("string"))
            failed = html_items.failed_pages(raw).select(*_PLACE, "source_file", "error")
            rows = questions.unionByName(failed, allowMissingColumns=True).withColumn("arrived", F.lit(number).cast("bigint"))
            kept = StateTable(batch.sparkSession, table)
            kept.add(_firsts(rows, source), number, checkpoint, most_parts, lambda parts: _firsts(parts, source))
        finally:
            raw.unpersist()

    writer = source.pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def kept_questions(spark: SparkSession, table: str, source: Source) -> tuple[DataFrame, DataFrame]:
    """What ``source_questions`` gives for all pages of the finished batches: the questions, and the pages that failed."""
    rows = _firsts(StateTable(spark, table).rows(), source)
    items = rows.where(F.col("error").isNull()).drop("error", "arrived").withColumn("parsed", F.lit(True))
    return first_questions(items, source), rows.where(F.col("error").isNotNull()).select(*_PLACE, "source_file", "error")
