"""What was shown last, kept current: the newest impressions of each learner.

The newest n of a learner are among the newest n of every part of the log, so
each micro-batch adds its own newest ones to a ``StateTable``, and a merge takes
the newest n of all parts. A learner has n rows in each of a few parts, however
long the log; late impressions fall into their place by time.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from recallgrid import schemas as S
from recallgrid.operators.recommend import latest
from recallgrid.streaming.answers import MOST_PARTS
from recallgrid.streaming.state_table import StateTable


def keep_recent(
    impressions: DataFrame,
    table: str,
    checkpoint: str,
    n: int = S.RECENT_QUESTIONS,
    available_now: bool = True,
    interval: str = "1 minute",
    most_parts: int = MOST_PARTS,
) -> StreamingQuery:
    """Start the stream that keeps the newest n impressions (username, question_id, id, shown_at) of each learner."""

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.select("username", "question_id", "id", "shown_at")
        StateTable(batch.sparkSession, table).add(latest(rows, n), number, checkpoint, most_parts, lambda kept: latest(kept, n))

    writer = impressions.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def recent_impressions(spark: SparkSession, table: str, n: int = S.RECENT_QUESTIONS) -> DataFrame:
    """The newest n impressions of each learner as of the last finished batch; n at most what is kept."""
    return latest(StateTable(spark, table).rows(), n)
