"""Totals by learner, topic and exam kept current by signed differences.

Each micro-batch folds its answers, looks up the state of the keys it changes
and nothing else, and adds what is new minus what was there to the totals: a
key seen for the first time is one more question, a further answer changes
attempts and priority of a question that counts already. Differences add up, so
the totals are a ``StateTable`` whose merge is a sum. The log is never read
again.

The totals take a batch before the state does. A writer lost in between leaves
the old state; the same batch then finds its differences in the totals, where
they count once, and brings the state after.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from recallgrid.functions.scoring import percent
from recallgrid.operators import exams
from recallgrid.operators.performance import KEY, answer_partials, merge_partials, partial_schema, priority
from recallgrid.sources.cell_table import CellTable, joined_on
from recallgrid.sources.storage import stored
from recallgrid.streaming.answers import ARRIVAL, MOST_PARTS
from recallgrid.streaming.state_table import StateTable

#: Buckets of the keys' state; a batch rewrites those with a changed key.
BUCKETS = 256
_SUMS = ["questions", "attempts", "correct", "priority"]


def _totals(path: str, spark: SparkSession) -> StateTable:
    return StateTable(spark, f"{path}/totals")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "username", "name").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _signed(partials: DataFrame, sign: int) -> DataFrame:
    values = {"questions": F.lit(1).cast("long"), "attempts": F.col("attempts"), "correct": F.col("correct"), "priority": priority()}
    return partials.select(*KEY, *[(F.lit(sign) * v).alias(c) for c, v in values.items()])


def _kinds(signed: DataFrame, questions: DataFrame) -> DataFrame:
    """Each difference once for its learner, topic and exam; unknown questions count for the learner only."""
    bank = questions.select("question_id", F.col("topic").cast("string").alias("topic"), F.col("reconstruction_name").alias("exam"), F.lit(True).alias("known"))

    def kind(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), value.cast("string").alias("name"))

    kinds = F.array(
        kind("learner", F.lit(None)),
        F.when(F.col("known"), kind("topic", F.col("topic"))),
        F.when(F.col("exam").isNotNull(), kind("exam", F.col("exam"))),
    )
    placed = signed.join(bank, "question_id", "left")
    return placed.select("username", *_SUMS, F.explode(F.array_compact(kinds)).alias("k")).select("k.kind", "username", "k.name", *_SUMS)


def add_batch(answers: DataFrame, questions: DataFrame, path: str, batch: int, stream: str, buckets: int = BUCKETS, most_parts: int = MOST_PARTS) -> int:
    """Answers into the state and their differences into the totals, each batch once; returns the buckets rewritten."""
    spark = answers.sparkSession
    number = T.StructField("batch", T.LongType())
    state = CellTable(spark, f"{path}/state", T.StructType([*partial_schema(answers), number]))
    now = state.manifest()
    if now.batch >= batch:
        return 0
    known = answers.withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))
    changed = merge_partials(answer_partials(known)).withColumn("batch", F.lit(batch).cast("long"))
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("string")
    changed = stored(changed.select(*state.schema.names), "changed")
    touched = [r[0] for r in changed.select(bucket).distinct().collect()]
    held = state.rows(now, touched)
    old = stored(joined_on(held, changed, KEY, "left_semi"), "old")
    new = stored(merge_partials(old.unionByName(changed), ARRIVAL).select(*state.schema.names), "new")
    difference = _summed(_kinds(_signed(new, 1).unionByName(_signed(old, -1)), questions))
    _totals(path, spark).add(difference, batch, stream, most_parts, _summed)
    state.replace(joined_on(held, new, KEY, "left_anti").unionByName(new), bucket, touched, batch, stream)
    return len(touched)


def keep_reports(
    answers: DataFrame,
    questions: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "1 minute",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Start the stream that keeps the totals. Priority follows arrival, as in ``keep_state``.

    A question counts under the topic and exam it has when its difference is
    taken: when the bank moves questions, build the totals anew.
    """

    def store(batch: DataFrame, number: int) -> None:
        add_batch(batch, questions, path, number, checkpoint, buckets)

    writer = answers.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def _of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return _summed(_totals(path, spark).rows().where(F.col("kind") == kind))


def user_totals(spark: SparkSession, path: str) -> DataFrame:
    """As stats.user_totals."""
    return _of(spark, path, "learner").select(
        "username",
        F.col("attempts").alias("total_answered"),
        F.col("correct").alias("total_correct"),
        percent(F.col("correct"), F.col("attempts")).alias("accuracy"),
    )


def topic_performance(spark: SparkSession, path: str) -> DataFrame:
    """As stats.topic_performance."""
    return _of(spark, path, "topic").select(
        "username",
        F.col("name").alias("topic"),
        F.col("questions").alias("questions_answered"),
        F.col("correct").alias("total_correct"),
        F.col("attempts").alias("total_attempts"),
        (F.col("priority") / F.col("questions")).alias("avg_priority"),
        percent(F.col("correct"), F.col("attempts")).alias("accuracy"),
    )


def topic_stats(spark: SparkSession, path: str) -> DataFrame:
    """As stats.topic_stats, in no order."""
    return topic_performance(spark, path).select(
        "username", "topic", F.col("total_attempts").alias("total"), F.col("total_correct").alias("correct"), "accuracy"
    )


def exam_progress(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """As exams.exam_progress."""
    done = _of(spark, path, "exam").select("username", "name", F.col("questions").alias("answered"), "correct")
    return exams.rates(done.join(exams.exam_totals(questions), "name"))
