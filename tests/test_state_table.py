import datetime

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import performance as P
from recallgrid.streaming import answers as stream
from recallgrid.streaming import impressions
from recallgrid.streaming.state_table import RETAINED, Manifest, StateTable

T0 = datetime.datetime(2024, 1, 1)
ANSWER = "id bigint, username string, question_id string, is_correct boolean, answered_at timestamp_ntz"


def loop(history):
    out, score, streak = [], None, 0
    for right in history:
        streak = streak + 1 if right else 0
        score = (-1.0 if right else 5.0) if score is None else max(score - 2.0, -10.0) if right else min(score + 5.0, 50.0)
        out.append((len(out) + 1, sum(history[: len(out) + 1]), streak, score))
    return out


def frame(spark, histories, start=0):
    rows, n = [], start
    for (user, question), history in histories.items():
        for right in history:
            n += 1
            rows.append((n, user, question, bool(right), T0 + datetime.timedelta(seconds=n)))
    return spark.createDataFrame(rows, ANSWER)


def test_one_busy_key_of_one_day_is_cut(spark, monkeypatch):
    history = [(i * i) % 7 not in (1, 2) for i in range(3000)]
    histories = {("hot", "q"): history, ("cool", "q"): [1, 0, 1], ("late", "q"): [0], ("hot", "z"): [1] * 40}
    monkeypatch.setattr(P, "SLICE_ROWS", 200)
    answers = frame(spark, histories)
    got = {}
    for r in P.running_state(answers).orderBy("id").collect():
        got.setdefault((r.username, r.question_id), []).append((r.attempt_no, r.correct_so_far, r.streak, r.priority_score))
    assert got == {k: loop([int(x) for x in v]) for k, v in histories.items()}
    assert P.running_state(answers.limit(0)).count() == 0


def test_odd_answers(spark):
    rows = [(1, "a", None, True, T0), (2, None, "q", None, None), (3, None, "q", True, T0), (3, None, "q", True, T0), (4, "a", None, False, T0)]
    got = P.running_state(spark.createDataFrame([(*r, "x") for r in rows], ANSWER + ", chunk string")).collect()
    assert sorted((r.id, r.attempt_no, r.streak) for r in got) == [(1, 1, 1), (2, 1, 0), (3, 2, 1), (3, 3, 2), (4, 2, 0)]


def batches(spark, tmp_path, n=13):
    """n files in order of time over a few keys."""
    log, at = str(tmp_path / "log"), 0
    histories = {("u", f"q{k}"): [] for k in range(3)}
    for b in range(n):
        part = {k: [(b + i + j) % 3 > 0 for i in range(4)] for j, k in enumerate(histories)}
        for k, v in part.items():
            histories[k] += v
        frame(spark, part, at).coalesce(1).write.mode("append").parquet(log)
        at += 12
    return log, histories


def state(frame):
    return {(r.username, r.question_id): (r.total_attempts, r.correct_attempts, r.streak, r.priority_score) for r in frame.collect()}


def test_parts_stay_few(spark, tmp_path):
    log, histories = batches(spark, tmp_path)
    bank = spark.createDataFrame([(f"q{k}", "t") for k in range(3)], "question_id string, topic string")
    arriving = spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 1).parquet(log)
    table = str(tmp_path / "state")
    stream.keep_state(arriving, table, str(tmp_path / "checkpoint"), most_parts=3).awaitTermination()
    held = StateTable(spark, table)
    assert state(stream.current_performance(spark, table, bank)) == {k: loop(v)[-1] for k, v in histories.items()}
    now = held.manifest()
    assert now.batch == 12 and now.version == 12 and len(now.parts) <= 4
    assert held.rows().groupBy("username", "question_id").count().agg(F.max("count")).first()[0] <= 4
    named = {p for v in held._versions() for p in held._read(v).parts}
    assert len(held._versions()) == RETAINED and set(held._names("parts")) == named
    # A merged part holds one row for each key.
    merged = [p for p in now.parts if p.startswith("merged")]
    assert len(merged) == 1 and held.part(merged[0]).count() == 3


def part_of(spark, batch, value):
    return spark.createDataFrame([("k", batch, value)], "key string, batch long, value long")


def total(rows):
    return rows.groupBy("key").agg(F.max("batch").alias("batch"), F.sum("value").alias("value"))


def test_crashes_between_the_steps(spark, tmp_path, monkeypatch):
    table = StateTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.rows()
    table.add(part_of(spark, 0, 1), 0, "s", 2, total)
    commit, tidy = StateTable.commit, StateTable._tidy

    def lost(*_):
        raise RuntimeError("lost")

    for step in ("commit", "_tidy"):
        monkeypatch.setattr(StateTable, step, lost)
        before = table.rows().agg(F.sum("value")).first()[0]
        number = table.manifest().batch + 1
        with pytest.raises(RuntimeError, match="lost"):
            table.add(part_of(spark, number, 10), number, "s", 2, total)
        # Lost before the rename: the old version; behind it: the new one. Never half of one.
        assert table.rows().agg(F.sum("value")).first()[0] == before + (10 if step == "_tidy" else 0)
        monkeypatch.setattr(StateTable, "commit", commit)
        monkeypatch.setattr(StateTable, "_tidy", tidy)
        table.add(part_of(spark, number, 10), number, "s", 2, total)
        assert table.rows().agg(F.sum("value")).first()[0] == before + 10
    old = table.manifest()
    for number in range(3, 9):
        table.add(part_of(spark, number, 100), number, "s", 2, total)
        if number == 3:
            assert table.rows(old).agg(F.sum("value")).first()[0] == 21
        assert len(table.manifest().parts) <= 3
    assert table.rows().agg(F.sum("value")).first()[0] == 621
    named = {p for v in table._versions() for p in table._read(v).parts}
    assert set(table._names("parts")) == named


def test_two_writers(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"))
    table.commit(Manifest(), 0, "s", [table.write(part_of(spark, 0, 1), "batch")])
    with pytest.raises(RuntimeError, match="another writer"):
        table.commit(Manifest(), 0, "s", [])
    with pytest.raises(ValueError, match="another stream"):
        table.add(part_of(spark, 1, 1), 1, "other", 2, total)
    assert len(table._versions()) == 1 and table.rows().count() == 1


def test_recent_impressions_stay_few(spark, tmp_path):
    log, shown = str(tmp_path / "shown"), []
    for b in range(6):
        # The fourth batch is late: older than all before it.
        rows = [(100 * b + i, f"u{i % 3}", f"q{(7 * b + i) % 11}", T0 + datetime.timedelta(minutes=(b if b != 3 else -5), seconds=i)) for i in range(40)]
        shown += rows
        spark.createDataFrame(rows, "id bigint, username string, question_id string, shown_at timestamp_ntz").coalesce(1).write.mode("append").parquet(log)
    schema = "id bigint, username string, question_id string, shown_at timestamp_ntz"
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
    table = str(tmp_path / "recent")
    impressions.keep_recent(arriving, table, str(tmp_path / "checkpoint"), n=4, most_parts=2).awaitTermination()
    got = sorted((r.username, r.id) for r in impressions.recent_impressions(spark, table, 4).collect())
    want = [(u, r[0]) for u in ("u0", "u1", "u2") for r in sorted((r for r in shown if r[1] == u), key=lambda r: (r[3], r[0]))[-4:]]
    assert got == sorted(want)
    held = StateTable(spark, table)
    assert held.rows().count() <= 3 * 4 * 3 and len(held.manifest().parts) <= 3 and held.manifest().batch == 5
