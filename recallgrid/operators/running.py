"""Ordered running values for keys of any size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.sources.storage import stored


def in_chunks(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with a ``chunk`` number that rises with (keys, order).

    Range partitioning cuts a key with very many rows over several chunks of
    bounded size. The result is stored, because chunk sums and rows must refer
    to the same chunks even when an executor is lost in between.
    """
    columns = [*keys, *order]
    numbered = (
        frame.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("chunk", F.spark_partition_id())
    )
    return stored(numbered, "chunks")


def total_before(frame: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key."""
    rows = in_chunks(frame, keys, order)
    earlier = Window.unboundedPreceding, -1
    sums = rows.groupBy(*keys, "chunk").agg(F.sum(value).alias("_sum"))
    offsets = sums.select(
        *keys,
        "chunk",
        F.coalesce(
            F.sum("_sum").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(*earlier)),
            F.lit(0),
        ).alias("_offset"),
    )
    local = F.coalesce(
        F.sum(value).over(Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(*earlier)),
        F.lit(0),
    )
    return (
        rows.withColumn("_local", local)
        .join(offsets, [*keys, "chunk"])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_offset", "_local", "chunk")
    )
