"""Tables kept current: late answers in a tree, totals by differences, changes by bucket."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import exams, stats
from recallgrid.operators.performance import performance
from recallgrid.sources.cell_table import CellTable
from recallgrid.sources.keyed_table import KeyedTable
from recallgrid.streaming import reports
from recallgrid.streaming.answer_tree import LEVELS, AnswerTree, keep_tree
from recallgrid.streaming.state_table import RETAINED, StateTable

ANSWER = "id bigint, username string, question_id string, is_correct boolean, answered_at timestamp_ntz"
T0 = datetime.datetime(2024, 1, 1)


def answer(n, day, user="u", question="q", right=True):
    return (n, user, question, right, T0 + datetime.timedelta(days=day, seconds=n % 1000))


@pytest.fixture(scope="module")
def bank(spark):
    rows = [("q", "t", "e"), ("r", "t", None), ("s", None, "e"), ("v", "w", "f")]
    return spark.createDataFrame(rows, "question_id string, topic string, reconstruction_name string")


def made(n, seed):
    pick = random.Random(seed)
    return [
        answer(i, pick.choice([-20_000, -3, 0, 1, 2, 15, 16, 40, 300, 9_000]), pick.choice("abc"), pick.choice("qrsx"), pick.random() < 0.5)
        for i in range(n)
    ]


def rows(frame):
    return sorted(frame.collect(), key=repr)


def test_any_order_gives_the_batch_fold(spark, tmp_path, bank):
    log = made(400, 1) + [(900, None, "q", True, T0), (901, "a", "q", None, None), (902, "a", "q", True, datetime.datetime(1700, 1, 1)), (902, "a", "q", False, None)]
    answers = spark.createDataFrame(log, ANSWER)
    tree = AnswerTree(spark, str(tmp_path / "t"), answers.schema)
    assert tree.state(bank).count() == 0
    random.Random(2).shuffle(log)
    for number in range(3):
        tree.add(spark.createDataFrame(log[number::3], ANSWER + ""), number, "s")
    known = answers.withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))
    assert rows(tree.state(bank)) == rows(performance(known, bank))
    for day in (datetime.date(2024, 1, 3), datetime.date(2024, 1, 17), datetime.date(2026, 1, 1)):
        before = known.where(F.col("answered_at").isNull() | (F.col("answered_at") < F.lit(datetime.datetime.combine(day, datetime.time()))))
        assert rows(tree.state_before(day, bank)) == rows(performance(before, bank))


def test_a_late_answer_writes_its_spans_only(spark, tmp_path, bank, monkeypatch):
    tree = AnswerTree(spark, str(tmp_path / "t"), spark.createDataFrame([], ANSWER).schema)
    log = [answer(i, i % 100, right=i % 3 > 0) for i in range(200)]
    tree.add(spark.createDataFrame(log, ANSWER), 0, "s")
    before = tree.nodes.cells()
    late = [answer(500, 7), answer(501, 7, "other", "r", False)]
    read, rows_of = [], CellTable.rows
    monkeypatch.setattr(CellTable, "rows", lambda self, now=None, cells=None: (cells := list(cells)) and read.append((self.path, cells)) or rows_of(self, now, cells))
    touched = tree.add(spark.createDataFrame(late, ANSWER), 1, "s")
    monkeypatch.undo()
    # One day of the log, one span on each level.
    assert [len(cells) for path, cells in read if path == tree.log.path] == [1]
    assert len(touched) == LEVELS + 1
    after = tree.nodes.cells()
    assert {c for c in after if after[c] != before.get(c)} == set(touched)
    assert rows(tree.state(bank)) == rows(performance(spark.createDataFrame(log + late, ANSWER), bank))
    assert tree.add(spark.createDataFrame(late, ANSWER), 1, "s") == []


def test_tree_writer_lost_between_log_and_nodes(spark, tmp_path, bank, monkeypatch):
    tree = AnswerTree(spark, str(tmp_path / "t"), spark.createDataFrame([], ANSWER).schema)
    first, second = made(50, 3), [(1000 + r[0], *r[1:]) for r in made(50, 4)]
    tree.add(spark.createDataFrame(first, ANSWER), 0, "s")

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(AnswerTree, "_replace", lost)
    with pytest.raises(RuntimeError, match="lost"):
        tree.add(spark.createDataFrame(second, ANSWER), 1, "s")
    monkeypatch.undo()
    assert rows(tree.state(bank)) == rows(performance(spark.createDataFrame(first, ANSWER), bank))
    tree.add(spark.createDataFrame(second, ANSWER), 1, "s")
    assert rows(tree.state(bank)) == rows(performance(spark.createDataFrame(first + second, ANSWER), bank))


def test_tree_as_a_stream(spark, tmp_path, bank):
    folder, log = str(tmp_path / "log"), made(60, 5)
    for part in (log[1::2], log[::2]):
        spark.createDataFrame(part, ANSWER).coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", 1).parquet(folder)
    keep_tree(arriving, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    tree = AnswerTree(spark, str(tmp_path / "t"), arriving.schema)
    assert tree.nodes.manifest().batch == 1
    assert rows(tree.state(bank)) == rows(performance(spark.createDataFrame(log, ANSWER), bank))


def reported(spark, path, bank):
    return [rows(f) for f in (reports.user_totals(spark, path), reports.topic_performance(spark, path), reports.topic_stats(spark, path), reports.exam_progress(spark, path, bank))]


def computed(answers, bank):
    perf = performance(answers, bank)
    return [rows(f) for f in (stats.user_totals(answers), stats.topic_performance(perf), stats.topic_stats(answers, bank), exams.exam_progress(answers, bank))]


def in_time(n, seed):
    """Batches follow time, so arrival and time give one order."""
    pick = random.Random(seed)
    return [answer(i, i // 1000, pick.choice(["a", "b", None]), pick.choice("qrsvx"), pick.random() < 0.5) for i in range(n)]


def test_totals_by_differences(spark, tmp_path, bank, monkeypatch):
    path, log = str(tmp_path / "r"), in_time(300, 6)

    def lost(*_):
        raise RuntimeError("lost")

    for number, start in enumerate(range(0, 300, 60)):
        batch = spark.createDataFrame(log[start : start + 60], ANSWER)
        if number == 2:
            # Lost between the totals and the state: the differences count once.
            monkeypatch.setattr(CellTable, "replace", lost)
            with pytest.raises(RuntimeError, match="lost"):
                reports.add_batch(batch, bank, path, number, "s", buckets=8, most_parts=2)
            monkeypatch.undo()
        reports.add_batch(batch, bank, path, number, "s", buckets=8, most_parts=2)
        assert reports.add_batch(batch, bank, path, number, "s", buckets=8, most_parts=2) == 0
        assert len(StateTable(spark, f"{path}/totals").manifest().parts) <= 3
    answers = spark.createDataFrame(log, ANSWER)
    assert reported(spark, path, bank) == computed(answers, bank)
    # A batch for one key rewrites one bucket.
    one = spark.createDataFrame([answer(999, 50, "a", "q")] * 2, ANSWER)
    assert reports.add_batch(one, bank, path, 5, "s", buckets=8, most_parts=2) == 1
    assert reports.add_batch(one.limit(0), bank, path, 6, "s", buckets=8, most_parts=2) == 0


def test_changes_rewrite_their_buckets(spark, tmp_path):
    content = [(f"k{i}", "old", f"text {i}", T0, T0) for i in range(500)] + [(None, "old", "no key", T0, T0)]
    schema = "question_id string, topic string, question_text string, created_at timestamp_ntz, updated_at timestamp_ntz"
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["question_id"], buckets=64)
    table.load(spark.createDataFrame(content, schema))
    with pytest.raises(ValueError, match="already"):
        table.load(spark.createDataFrame(content, schema))
    before = table.cells.cells()
    changes = spark.createDataFrame([(f"k{i}", "new", "changed", i) for i in range(495, 505)], "question_id string, topic string, question_text string, place int")
    old, now = table.cells.manifest(), F.lit(T0 + datetime.timedelta(days=1))
    touched = table.upsert(changes.unionByName(changes.withColumn("topic", F.lit("first")).withColumn("place", F.lit(-1))), now, "place")
    after = table.cells.cells()
    assert len(touched) <= 10
    assert {c for c in after.keys() | before.keys() if after.get(c) != before.get(c)} == set(touched)
    topics = {r.question_id: r.topic for r in table.rows().collect()}
    assert topics == {None: "old"} | {f"k{i}": "old" for i in range(495)} | {f"k{i}": "new" for i in range(495, 505)}
    assert table.rows().count() == 506
    # A reader of the old version still has it.
    assert table.cells.rows(old).where("topic = 'new'").count() == 0
    wanted = spark.createDataFrame([("k3",), ("k500",), ("none",), (None,)], "question_id string")
    found = table.lookup(wanted)
    assert sorted(r.question_id or "" for r in found.collect()) == ["", "k3", "k500"]
    assert len(found.inputFiles()) < len(table.rows().inputFiles())
    assert len(table.remove(wanted)) <= 4 and table.rows().count() == 503
    assert table.remove(wanted.limit(0)) == [] and table.cells.manifest().version == 2


def test_old_cells_leave_the_disk(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k int, v int").schema, ["k"], buckets=8)
    table.load(spark.range(100).selectExpr("CAST(id AS INT) AS k", "0 AS v"))
    one = spark.createDataFrame([(5,)], "k int")
    for n in range(RETAINED + 2):
        table.change(one, lambda rows: rows.withColumn("v", F.col("v") + F.when(F.col("k") == 5, 1).otherwise(0)))
    assert table.rows().agg(F.sum("v"), F.count("k")).first() == (RETAINED + 2, 100)
    cells = table.cells
    named = {p for v in cells._versions() for p in cells._read(v).parts}
    there = {f"{part}/{c}" for part in cells._names("parts") for c in cells._names(f"parts/{part}") if c.startswith("cell=")}
    assert there == named and len(cells._versions()) == RETAINED


def test_rows_outside_the_change_are_refused(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k int, v int").schema, ["k"], buckets=64)
    table.load(spark.createDataFrame([(1, 1)], "k int, v int"))
    one = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="not replaced"):
        table.change(one, lambda rows: rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))))
    assert table.rows().count() == 1
