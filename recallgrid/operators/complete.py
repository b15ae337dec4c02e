"""Complete reports: every given learner with every row of a dimension."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.running import total_before

# Rows of the dimension that are attached to a learner row as one array.
_CHUNK = 1_000


def with_every(users: DataFrame, dimension: DataFrame) -> DataFrame:
    """Each learner with each row of a dimension (topics, exam totals).

    The result has learners x rows by definition: pass the learners that the
    report is for. The dimension is cut by hash into arrays of about _CHUNK
    rows, learners meet one array row per chunk in an equi-join, and the arrays
    are expanded there; only the number of chunks passes through the driver.
    """
    names = dimension.columns
    count = dimension.agg(F.greatest(F.ceil(F.count(F.lit(1)) / _CHUNK), F.lit(1)))
    chunks = count.scalar()
    listed = (
        dimension.withColumn("_chunk", F.pmod(F.xxhash64(*names), chunks))
        .groupBy("_chunk")
        .agg(F.collect_list(F.struct(*names)).alias("_rows"))
    )
    asked = users.select("username").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    expanded = asked.join(listed, "_chunk").select("username", F.explode("_rows").alias("row"))
    return expanded.select("username", *[F.col(f"row.{c}").alias(c) for c in names])


def first_missing(users: DataFrame, listed: DataFrame, numbered: DataFrame, n: int) -> DataFrame:
    """The first n values of a numbered dimension that a learner's list lacks.

    numbered: value, rank (0, 1, ... without gaps). listed: username, value.
    With the ranks of a learner's own values at hand, the missing ones are the
    gaps among them, so n per learner are found without listing the dimension.
    """
    own = (
        listed.select("username", "value").distinct().join(numbered, "value")
        .groupBy("username")
        .agg(F.collect_list("rank").alias("_own"))
    )
    total = numbered.agg(F.count(F.lit(1))).scalar()
    none = F.array().cast("array<bigint>")
    held = F.coalesce("_own", none)
    top = F.least(F.lit(n) + F.size(held), total)
    ranks = F.slice(F.array_except(F.when(top > 0, F.sequence(F.lit(0).cast("bigint"), top - 1)).otherwise(none), held), 1, n)
    gaps = users.select("username").join(own, "username", "left").select("username", F.explode(ranks).alias("rank"))
    return gaps.join(numbered, "rank").select("username", "value")


def numbered(values: DataFrame) -> DataFrame:
    """Distinct non-null values of a one-column frame with their rank in order: value, rank.

    Ranks are counts per range of values plus a row number inside the range.
    """
    one = values.toDF("value").where("value is not null").distinct().withColumn("_one", F.lit(1))
    return total_before(one, [], ["value"], "_one", "rank").select("value", F.col("rank").cast("bigint").alias("rank"))
