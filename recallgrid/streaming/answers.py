"""The answer log as a stream: keep learner state current.

Each micro-batch is folded to partial rows with the batch operator, so a busy
key is spread over tasks here too, and the partials become a part of a
``StateTable``. A retried batch that is in the table changes nothing, which
makes the result exactly-once, and every few batches all parts are merged to
one. Reading composes the partials of a key in batch order: like the insert
trigger, a late answer counts when it arrives.
"""

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallgrid import schemas as S
from recallgrid.operators.performance import (
    KEY,
    answer_partials,
    compose_runs,
    merge_partials,
    performance_from_partials,
    single_answers,
)
from recallgrid.streaming.state_table import Manifest, StateTable


ARRIVAL = ("batch", "first_at", "first_id")
#: Parts beside the merged one before all are merged.
MOST_PARTS = 8


def keep_state(
    answers: DataFrame,
    table: str,
    checkpoint: str,
    available_now: bool = True,
    interval: str = "1 minute",
    questions: DataFrame | None = None,
    most_parts: int = MOST_PARTS,
) -> StreamingQuery:
    """Start the stream that keeps the partials of every micro-batch.

    A key has at most ``most_parts + 1`` partials, one of them merged; see
    ``StateTable`` for what a crash leaves behind (nothing a reader sees).
    With ``questions`` a partial keeps the topic that its question has when the
    batch arrives; the state then shows the topic of a key's first answer.
    """

    def store(batch: DataFrame, number: int) -> None:
        partials = merge_partials(answer_partials(batch))
        if questions is not None:
            partials = partials.join(questions.select("question_id", "topic"), "question_id", "left")
        partials = partials.withColumn("batch", F.lit(number).cast("long"))
        state = StateTable(batch.sparkSession, table)
        state.add(partials, number, checkpoint, most_parts, lambda rows: merge_partials(rows, ARRIVAL))

    writer = answers.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def stored_partials(spark: SparkSession, table: str) -> DataFrame:
    """All partials of the newest version with the batch they came from (a merged one: the first)."""
    return StateTable(spark, table).rows()


def current_performance(spark: SparkSession, table: str, questions: DataFrame) -> DataFrame:
    """The performance table as of the last finished batch."""
    return performance_from_partials(stored_partials(spark, table), questions, ARRIVAL)


def compact(spark: SparkSession, table: str, up_to: int, target: str) -> None:
    """Fold all batches up to a number into one row per key, in a new table."""
    source, new = StateTable(spark, table), StateTable(spark, target)
    now = source.manifest()
    partials = source.rows(now)
    merged = merge_partials(partials.where(F.col("batch") <= up_to), ARRIVAL)
    parts = [
        new.write(merged.withColumn("batch", F.lit(up_to).cast("long")), "merged"),
        new.write(partials.where(F.col("batch") > up_to), "batches"),
    ]
    new.commit(Manifest(), now.batch, now.stream, parts)


# --- The same state in Spark's state store, for low latency ------------------

#: State rows that all keys share, unless the stream is started with another number.
STATE_BUCKETS = 1024

_STATE = "packed binary"
_HELD = ["topic", "total", "correct", "streak", "priority", "last_us"]


def stateful_performance(answers: DataFrame, questions: DataFrame, buckets: int = STATE_BUCKETS) -> DataFrame:
    """Changed performance rows of every micro-batch (update mode, no timeout).

    The topic is joined from the static bank and kept from the first answer on.
    Within a micro-batch the answers of a key are ordered by time and folded in
    that order; batches follow arrival. The state store holds the keys of a
    hash bucket as one packed row, so a step in Python advances all of a
    bucket's keys at once, and its cost goes with the answers and not with a
    call for each key. A bucket receives its answers of one batch at a time and
    is written again when one of its keys changes: the size of a batch and
    ``buckets`` bound the step. The number is part of the checkpoint; choose it
    for some ten thousand keys a bucket. ``keep_state`` spreads a busy key and
    needs no such bound.
    """
    topics = questions.select("question_id", F.col("topic").cast("string"))
    enriched = answers.select(*KEY, "answered_at", "id", "is_correct").join(topics, "question_id")
    # Keys with and without a learner never share a bucket: beside a null, pandas would hold whole numbers as floats.
    bucket = 2 * F.pmod(F.xxhash64(*KEY), F.lit(buckets)) + F.isnull("username").cast("long")
    keys = [T.StructField(k, answers.schema[k].dataType) for k in KEY]
    out_schema = T.StructType([*keys, *[f for f in S.PERFORMANCE.fields if f.name not in KEY]])
    return enriched.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _advance, out_schema, _STATE, "update", GroupStateTimeout.NoTimeout
    )


def _packed(held: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    table = pa.Table.from_pandas(held, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue()


def _key_codes(held: pd.DataFrame | None, rows: pd.DataFrame) -> np.ndarray:
    """A number for the key of each held row and then of each answer, by first appearance."""
    frames = [rows] if held is None else [held, rows]
    code = np.zeros(sum(map(len, frames)), dtype=np.int64)
    for name in KEY:
        found, values = pd.factorize(pd.concat([f[name] for f in frames], ignore_index=True), use_na_sentinel=False)
        code = pd.factorize(code * len(values) + found)[0]
    return code


def _advance(_bucket: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(chunks), ignore_index=True)
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
    n = 0 if held is None else len(held)
    # Held keys are distinct, so theirs are the numbers below n, in their order.
    rows = rows.assign(key=_key_codes(held, rows)[n:]).sort_values(["key", "answered_at", "id"], ignore_index=True)
    runs, first = compose_runs(single_answers(rows, ["key"]), ["key"]), rows.drop_duplicates("key", ignore_index=True)
    at = first["key"].to_numpy()
    known = at < n
    began = runs["first_correct"].to_numpy(dtype=bool)
    start = np.where(began, S.FIRST_CORRECT_PRIORITY - S.CORRECT_STEP, S.FIRST_WRONG_PRIORITY - S.WRONG_STEP).astype(float)
    zeros = np.zeros(len(at), dtype=np.int64)
    before = dict(zip(_HELD, (first["topic"].to_numpy(dtype=object), zeros, zeros, zeros, start, zeros)))
    if held is not None:
        for c in _HELD:
            before[c] = before[c].copy()
            before[c][known] = held[c].to_numpy()[at[known]]
    p = {c: runs[c].to_numpy() for c in ("attempts", "correct", "streak", "add", "lo", "hi")}
    changed = first[KEY].assign(
        topic=before["topic"],
        total=before["total"] + p["attempts"],
        correct=before["correct"] + p["correct"],
        streak=p["streak"] + np.where(p["streak"] == p["attempts"], before["streak"], 0),
        priority=np.minimum(p["hi"], np.maximum(p["lo"], before["priority"] + p["add"])),
        last_us=runs["last_at"].to_numpy().astype("datetime64[ns]").astype(np.int64) // 1_000,
    )
    kept = np.ones(n, dtype=bool)
    kept[at[known]] = False
    state.update((_packed(pd.concat([held[kept], changed], ignore_index=True) if kept.any() else changed),))
    yield changed[KEY].assign(
        topic=changed["topic"],
        total_attempts=changed["total"],
        correct_attempts=changed["correct"],
        incorrect_attempts=changed["total"] - changed["correct"],
        last_answered_at=changed["last_us"].to_numpy().astype("datetime64[us]"),
        streak=changed["streak"],
        priority_score=changed["priority"],
    )
