"""The fold against a plain loop, whatever the history and wherever it is cut."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.operators import performance as P
from recallgrid.operators.mastery import topic_mastery_levels
from recallgrid.operators.stats import topic_performance
from recallgrid.streaming import answers as stream

T0 = datetime.datetime(2024, 1, 1)
ANSWER = "id bigint, username string, question_id string, is_correct boolean, answered_at timestamp_ntz"


def loop(history):
    total = correct = streak = 0
    score = None
    for right in history:
        total += 1
        correct += right
        streak = streak + 1 if right else 0
        if score is None:
            score = -1.0 if right else 5.0
        elif right:
            score = max(score - 2.0, -10.0)
        else:
            score = min(score + 5.0, 50.0)
    return total, correct, streak, score


def rows(histories):
    out, n = [], 0
    for (user, question), history in histories.items():
        for right in history:
            n += 1
            out.append((n, user, question, right, T0 + datetime.timedelta(seconds=n)))
    return out


def state(frame):
    return {
        (r.username, r.question_id): (r.total_attempts, r.correct_attempts, r.streak, r.priority_score)
        for r in frame.collect()
    }


@pytest.fixture(scope="module")
def bank(spark):
    return spark.createDataFrame([(q, "t") for q in "abcdef"], "question_id string, topic string")


VECTORS = {
    ("u", "a"): [True],
    ("u", "b"): [False],
    ("u", "c"): [True, True, False, True],
    ("u", "d"): [True] * 7,
    ("u", "e"): [False] * 12,
    ("v", "a"): [True, False] * 40 + [True] * 3,
}


def test_unit_vectors(spark, bank):
    unknown = {("u", "zzz"): [True]}
    answers = spark.createDataFrame(rows(VECTORS | unknown), ANSWER)
    found = state(P.performance(answers, bank))
    assert found == {k: loop(v) for k, v in VECTORS.items()}
    assert found["u", "c"][3] == 0.0
    assert found["u", "d"][3] == -10.0
    assert found["u", "e"][3] == 50.0


def test_one_key_over_many_partitions(spark, bank):
    import random

    rng = random.Random(1)
    histories = {("hot", "a"): [rng.random() < 0.7 for _ in range(30_000)], ("u", "b"): [True, False]}
    answers = spark.createDataFrame(rows(histories), ANSWER).repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        partials = P.answer_partials(answers)
        assert partials.where("username = 'hot'").count() > 1
        assert state(P.performance_from_partials(partials, bank)) == {
            k: loop(v) for k, v in histories.items()
        }
        progress = P.answer_progress(answers).where("username = 'hot'").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    n = right = streak = 0
    for r in progress:
        n, right, streak = n + 1, right + r.is_correct, streak + 1 if r.is_correct else 0
        assert (r.attempt_no, r.correct_so_far, r.streak) == (n, right, streak)
    assert n == 30_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60), st.integers(1, 59))
def test_cut_anywhere(history, cut):
    """Composing the folds of two pieces equals folding the whole."""
    import pandas as pd

    frame = pd.DataFrame(
        rows({("u", "a"): history}), columns=["id", "username", "question_id", "is_correct", "answered_at"]
    )
    pieces = [p for p in (frame.iloc[:cut], frame.iloc[cut:]) if len(p)]
    folded = [P.compose_runs(P.single_answers(p)) for p in pieces]
    whole = P.compose_runs(pd.concat(folded, ignore_index=True))
    assert len(whole) == 1
    f = whole.iloc[0]
    start = 1.0 if f.first_correct else 0.0
    score = min(f.hi, max(f.lo, start + f["add"]))
    assert (f.attempts, f.correct, f.streak, score) == loop(history)
    assert -10.0 <= score <= 50.0


def test_refresh_day_by_day(spark, bank):
    answers = spark.createDataFrame(rows(VECTORS), ANSWER)
    middle = T0 + datetime.timedelta(seconds=50)
    early, late = answers.where(answers.answered_at <= middle), answers.where(answers.answered_at > middle)
    partials = P.refresh_partials(P.merge_partials(P.answer_partials(early)), late)
    assert state(P.performance_from_partials(partials, bank)) == {k: loop(v) for k, v in VECTORS.items()}


def write_batches(spark, folder, histories, n):
    """Answers as n files in time order."""
    data = rows(histories)
    data.sort(key=lambda r: (r[4], r[0]))
    step = -(-len(data) // n)
    for i in range(n):
        part = spark.createDataFrame(data[i * step : (i + 1) * step], ANSWER)
        part.coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def long_histories():
    import random

    rng = random.Random(2)
    return {(u, q): [rng.random() < 0.6 for _ in range(rng.randint(3, 30))] for u in "uvw" for q in "abc"}


def test_stream_equals_batch(spark, bank, tmp_path, long_histories):
    folder = str(tmp_path / "log")
    write_batches(spark, folder, long_histories, 3)
    answers = spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 1).parquet(folder)
    table = str(tmp_path / "state")
    stream.keep_state(answers, table, str(tmp_path / "checkpoint")).awaitTermination()
    wanted = {k: loop(v) for k, v in long_histories.items()}
    assert state(stream.current_performance(spark, table, bank)) == wanted
    assert stream.stored_partials(spark, table).select("batch").distinct().count() == 3
    target = str(tmp_path / "compacted")
    stream.compact(spark, table, 1, target)
    assert state(stream.current_performance(spark, target, bank)) == wanted
    assert stream.stored_partials(spark, target).select("batch").distinct().count() == 2


def test_stateful_stream_equals_batch(spark, bank, tmp_path, long_histories):
    folder = str(tmp_path / "log")
    write_batches(spark, folder, long_histories, 3)
    answers = spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 1).parquet(folder)
    latest = {}

    def keep(batch, number):
        latest.update(state(batch))

    started = (
        stream.stateful_performance(answers, bank)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    assert latest == {k: loop(v) for k, v in long_histories.items()}


@pytest.mark.parametrize(
    "right, wrong, n, level",
    [(9, 1, 19, 4), (9, 1, 20, 5), (8, 2, 15, 4), (7, 3, 10, 3), (6, 4, 5, 2), (599, 401, 2, 0), (599, 401, 3, 1)],
)
def test_levels(spark, right, wrong, n, level):
    perf = spark.createDataFrame(
        [("u", f"q{i}", "t", right, right + wrong, 0.0) for i in range(n)],
        "username string, question_id string, topic string, correct_attempts bigint, "
        "total_attempts bigint, priority_score double",
    )
    row = topic_mastery_levels(perf).first()
    assert row.level == level
    assert topic_performance(perf).first().accuracy == pytest.approx(row.accuracy)
