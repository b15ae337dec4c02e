"""Sinks with the checks that belong to them."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recallgrid.operators.dedup import duplicate_report
from recallgrid.operators.enrich import unclassified_report
from recallgrid.operators.quality import require_count, require_none, require_rows
from recallgrid.sources.storage import new_path


def write_questions(questions: DataFrame, path: str, validate: bool = True) -> int:
    """JSON sink: not empty, no id twice, and as many rows read back as written.

    Needs an ``ordinal`` column for the duplicate report; it is not written.
    The checks and the write each read the input: pass a stored frame.
    """
    require_rows(questions, "questions to write")
    if validate:
        require_none(duplicate_report(questions), "duplicate question ids", shown=10)
    rows = questions.drop("ordinal", "source_rank")
    # Counted while they are written, so nothing is computed twice for it.
    passed = Observation("written")
    counted = rows.observe(passed, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    expected = passed.get["n"]
    written = questions.sparkSession.read.schema(rows.schema).json(path)
    require_count(written, expected, f"rows in {path}")
    return expected


def write_unclassified(merged: DataFrame, path: str) -> None:
    unclassified_report(merged).write.mode("overwrite").csv(path, header=True)


def append(rows: DataFrame, path: str) -> None:
    """Append answers, reviews or new questions to their table."""
    rows.write.mode("append").parquet(path)


def replace_table(rows: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Write the new content of a table to a fresh path and return it.

    A table cannot be overwritten while it is read; the caller switches to the
    returned path once the write has succeeded.
    """
    path = new_path(rows.sparkSession, name)
    writer = rows.write.mode("errorifexists")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def write_jdbc(rows: DataFrame, table: str, url: str, batch_size: int = 100, **options) -> None:
    rows.write.format("jdbc").options(
        url=url, dbtable=table, batchsize=batch_size, **options
    ).mode("append").save()
