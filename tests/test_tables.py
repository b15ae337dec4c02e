"""Table maintenance, sources and sinks, and the two whole jobs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from recallgrid import schemas as S
from recallgrid.operators import complete, dedup, enrich, exams, images, lookups, maintenance
from recallgrid.operators.quality import CheckFailed
from recallgrid.plans import build_bank
from recallgrid.sources import readers, writers

OLD, NEW = datetime.datetime(2024, 1, 1), datetime.datetime(2025, 1, 1)


def option(letter, right):
    return {"letter": f"{letter}.", "text": letter.upper(), "explanation": "", "is_correct": right}


def question(qid, **changes):
    base = {
        "question_id": qid,
        "question_number": "1",
        "topic": "Diabetes",
        "question_text": f"text of {qid}",
        "answer_options": [option("a", True), option("b", False)],
        "correct_answer": "a. A",
        "explanation": "",
        "images": [],
        "source_file": "f.html",
        "source_type": "s",
    }
    return base | changes


def test_upsert(spark):
    schema = "question_id string, topic string, created_at timestamp_ntz, updated_at timestamp_ntz"
    table = spark.createDataFrame([("a", "x", OLD, OLD), ("b", "y", OLD, OLD)], schema)
    changes = spark.createDataFrame([("b", "one", 0), ("b", None, 1), ("c", "z", 0)], "question_id string, topic string, n int")
    rows = maintenance.upsert(table, changes, F.lit(NEW).cast("timestamp_ntz"), order="n").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[0]) == [
        ("a", "x", OLD, OLD),
        ("b", None, OLD, NEW),
        ("c", "z", NEW, NEW),
    ]


def test_cards(spark):
    schema = "username string, id bigint, front_text string, back_text string, topic string, created_at bigint, archived boolean"
    cards = spark.createDataFrame(
        [("u", 1, "f", "b", None, 1, False), ("u", 2, "g", "b", "t", 2, False), ("v", 3, "f", "b", None, 3, True)], schema
    )
    documents = {u: maintenance.deck_as_json(cards, u).first().json for u in "uv"}
    assert json.loads(documents["u"]) == [
        {"front_text": "g", "back_text": "b", "topic": "t"},
        {"front_text": "f", "back_text": "b", "topic": None},
    ]
    assert documents["v"] == "[]"
    lines = maintenance.cards_from_lines(maintenance.card_lines(cards))
    assert {(r.username, r.front_text, r.topic) for r in lines.collect()} == {("u", "f", None), ("u", "g", "t")}
    incoming = spark.createDataFrame([("w", documents["u"]), ("u", documents["u"])], "username string, json string")
    marked = maintenance.insert_new(cards, maintenance.cards_from_json(incoming), ["username", "front_text"], ["ordinal"])
    assert {r.outcome: r.n for r in maintenance.outcome_counts(marked).collect()} == {"inserted": 2, "skipped": 2}
    assert {r.username for r in maintenance.rows_to_append(marked).collect()} == {"w"}
    changes = spark.createDataFrame(
        [(1, "g", "x", "t"), (2, "h", "y", None)], "id bigint, front_text string, back_text string, topic string"
    )
    after = {r.id: (r.front_text, r.back_text, r.topic) for r in maintenance.update_cards(cards, changes, ["id"]).collect()}
    assert after == {1: ("f", "b", None), 2: ("h", "y", None), 3: ("f", "b", None)}
    gone = maintenance.archive_cards(cards, changes.where("id = 1"), ["id"])
    assert {r.id for r in maintenance.active_cards(gone).collect()} == {2}


def test_clear_and_replay(spark):
    t = spark.range(3).withColumn("username", F.lit("u"))
    cleared = maintenance.clear_everything({"questions": t, "cards": t})
    assert {r.table: r.n for r in maintenance.table_sizes(cleared).collect()} == {"questions": 0, "cards": 3}
    backup = spark.createDataFrame(
        [("u", "q", "a", 1, "2024-01-01 10:00:00")],
        "username string, question_id string, selected_answer string, is_correct int, timestamp string",
    )
    row = maintenance.replay_answers(backup, 5).first()
    assert row.id >= 5
    assert (row.is_correct, row.answered_at) == (True, datetime.datetime(2024, 1, 1, 10))
    assert [f.name for f in maintenance.replay_answers(backup, 5).schema] == [f.name for f in S.ANSWERS]


def test_parts_of_the_bank(spark):
    bank = spark.createDataFrame(
        [("b", "2", "t", ["u"], 0), ("a", "1", "t", [], 1), ("c", "3", "s", [], 2)],
        "question_id string, question_number string, topic string, images array<string>, ordinal int",
    )
    ids = lambda frame: [r.question_id for r in frame.collect()]
    assert ids(lookups.of_topics(bank, "t")) == ["a", "b"]
    assert ids(lookups.by_id(bank, "c")) == ["c"] and ids(lookups.by_id(bank, "x")) == []
    assert ids(lookups.with_images(bank)) == ["b"]
    assert ids(lookups.first_rows(bank, 2)) == ["b", "a"]
    renamed = lookups.rename_category(bank.withColumn("category", F.lit("k")))
    assert "category" not in renamed.columns and renamed.first().topic == "k"
    assert ids(lookups.by_id(bank, "a", *map(str, range(3000)))) == ["a"]


def test_exam_of_one_learner(spark):
    bank = spark.createDataFrame(
        [("a", "E1", 2), ("b", "E1", 1), ("c", "E2", 1), ("d", None, None)],
        "question_id string, reconstruction_name string, reconstruction_order bigint",
    )
    answers = spark.createDataFrame(
        [("u", "a", True)] * 3 + [("u", "d", True), ("v", "c", False)],
        "username string, question_id string, is_correct boolean",
    )
    rows = [tuple(r) for r in exams.exam_progress_of(answers, bank, "u").collect()]
    assert rows == [("u", "E1", 2, 1, 3, 300.0, 50.0), ("u", "E2", 1, 0, 0, 0.0, 0.0)]
    assert [r.question_id for r in exams.exam_questions(bank, "E1").collect()] == ["b", "a"]
    complete = exams.exam_progress_all(answers, bank)
    assert complete.count() == 4
    assert [tuple(r) for r in complete.where("username = 'u'").collect()] == rows


def test_complete_reports_take_a_dimension_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(complete, "_CHUNK", 2)
    users = spark.createDataFrame([("u",), ("v",)], "username string")
    names = spark.createDataFrame([(f"n{i}",) for i in range(25)], "name string")
    rows = [tuple(r) for r in complete.with_every(users, names).collect()]
    assert sorted(rows) == sorted((u, f"n{i}") for u in "uv" for i in range(25))
    assert complete.with_every(users, names.limit(0)).count() == 0


def test_deduplication_is_stable(spark):
    rows = [(i, f"  Text {i % 7}" + " " * (i % 3), i % 3, i) for i in range(60)]
    bank = spark.createDataFrame(rows, "question_id int, question_text string, source_rank int, ordinal int")
    once = dedup.drop_text_duplicates(bank)
    kept = {r.question_id for r in once.collect()}
    assert len(kept) == 7 and kept == {r.question_id for r in dedup.drop_text_duplicates(once).collect()}
    for r in once.collect():
        same = [(x[2], x[3]) for x in rows if x[1].strip() == r.question_text.strip()]
        assert (r.source_rank, r.ordinal) == min(same)


def test_topic_lookup_order(spark):
    bank = spark.createDataFrame([("a", " "), ("b", "own"), ("c", ""), ("d", None)], "question_id string, topic string")
    lookup = "question_id string, topic string, ordinal bigint"
    history = spark.createDataFrame([("a", "h1", 0), ("a", "h2", 1), ("c", "", 2)], lookup)
    manual = spark.createDataFrame([("b", "m", 0), ("a", "m", 1)], lookup)
    with_manual = {r.question_id: r.topic for r in enrich.merge_topics(bank, history, manual).collect()}
    assert with_manual == {"a": "m", "b": "own", "c": "", "d": S.UNCLASSIFIED}
    strict = {r.question_id: r.topic for r in enrich.merge_topics(bank, history, blank_history_matches=False).collect()}
    assert strict == {"a": "h2", "b": "own", "c": S.UNCLASSIFIED, "d": S.UNCLASSIFIED}


def test_image_rewrite(spark):
    bank = spark.createDataFrame(
        [("a", ["u1", "", "u2", "http://hosted/x", "u1"]), ("b", [])], "question_id string, images array<string>"
    )
    image_map = spark.createDataFrame([("u1", "n1")], "original_url string, hosted_url string")
    rows = {r.question_id: r.images for r in images.rewrite_images(bank, image_map).collect()}
    assert rows == {"a": ["n1", "", "u2", "http://hosted/x", "n1"], "b": []}
    classified = images.classify_images(bank, image_map)
    assert tuple(images.rewrite_counters(classified).first()) == (5, 2, 1, 1)
    assert tuple(images.migration_status(classified).first()) == (4, 1, 2, 1, 3)


def test_json_files(spark, tmp_path):
    path = tmp_path / "bank.json"
    path.write_text(json.dumps([question("a"), {"question_id": "b"}]))
    rows = {r.question_id: r for r in readers.read_questions_json(spark, str(path)).collect()}
    assert rows["a"].answer_options[0].is_correct and rows["b"].images == [] and rows["b"].topic is None
    raw = {r.question_id: json.loads(r.json) for r in readers.read_raw_questions(spark, str(path)).collect()}
    assert raw == {"a": question("a"), "b": {"question_id": "b"}}
    (tmp_path / "empty.json").write_text("[]")
    with pytest.raises(CheckFailed):
        readers.read_questions_json(spark, str(tmp_path / "empty.json"))
    out = str(tmp_path / "out")
    questions = readers.read_questions_json(spark, str(path))
    assert writers.write_questions(questions.withColumn("ordinal", F.lit(0)), out) == 2
    assert "reconstruction_name" in spark.read.json(out).columns
    twice = questions.unionByName(questions).withColumn("ordinal", F.monotonically_increasing_id())
    with pytest.raises(CheckFailed):
        writers.write_questions(twice, str(tmp_path / "twice"))


def test_lookups(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"u": "n", "v": "m"}))
    assert sorted(map(tuple, readers.read_image_map(spark, str(tmp_path / "map.json")).collect())) == [("u", "n"), ("v", "m")]
    assert readers.read_image_map(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "manual.csv").write_text("question_id,topic\na,Diabetes\n")
    assert readers.read_manual_topics(spark, str(tmp_path / "manual.csv")).first().topic == "Diabetes"
    (tmp_path / "bad.csv").write_text("question_id,topic\na,Cocina\n")
    with pytest.raises(CheckFailed):
        readers.read_manual_topics(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "short.csv").write_text("question_id\na\n")
    with pytest.raises(ValueError):
        readers.read_manual_topics(spark, str(tmp_path / "short.csv"))
    assert readers.read_manual_topics(spark, str(tmp_path / "none.csv")) is None
    (tmp_path / "old.json").write_text(json.dumps([{"question_id": "a", "topic": "t", "x": 1}, {"topic": "t"}]))
    assert [r.question_id for r in readers.read_history(spark, str(tmp_path / "old.json")).collect()] == ["a"]
    assert readers.read_history(spark, str(tmp_path / "none.json")).count() == 0


QUIZ = """<div id="question-1-{n}"><span class="qno">Pregunta {n}</span><div class="qtext">{text}</div>
<div class="r0"><div class="d-flex"><span class="answernumber">a.</span><div class="flex-fill">Sí</div></div></div>
<div class="r1"><div class="d-flex"><span class="answernumber">b.</span><div class="flex-fill">No</div></div></div>
<div class="rightanswer">La respuesta correcta es: No</div></div>"""


def test_pages_to_bank(spark, tmp_path):
    exam = tmp_path / "site" / "Reconstrucciones" / "Agosto 2021"
    exam.mkdir(parents=True)
    (exam / "01.html").write_text(QUIZ.format(n=1, text="Primera") + QUIZ.format(n=2, text="Segunda"))
    (exam / "02.htm").write_text(QUIZ.format(n=3, text="Tercera"))
    (tmp_path / "site" / "x.html").write_text(QUIZ.format(n=4, text="primera ") + QUIZ.format(n=5, text="Quinta"))
    plain = readers.read_pages(spark, str(tmp_path / "site"), recursive=True)
    exams = readers.read_pages(spark, str(tmp_path / "site"), recursive=True, without="").where("path like '%Reconstrucciones%'")
    assert plain.count() == 1 and exams.count() == 2
    sources = [
        build_bank.Source(exams, "quiz", "exam", exam_prefix="exam"),
        build_bank.Source(plain, "quiz", "quiz"),
    ]
    history = spark.createDataFrame([("question-1-5", "Diabetes", 0)], "question_id string, topic string, ordinal bigint")
    rows = {r.question_id: r for r in build_bank.build_bank(sources, history).collect()}
    assert {i: (r.reconstruction_order, r.topic) for i, r in rows.items()} == {
        "exam_agosto_2021_question-1-1": (1, S.UNCLASSIFIED),
        "exam_agosto_2021_question-1-2": (2, S.UNCLASSIFIED),
        "exam_agosto_2021_question-1-3": (3, S.UNCLASSIFIED),
        "question-1-5": (None, "Diabetes"),
    }
    first = rows["exam_agosto_2021_question-1-1"]
    assert first.correct_answer == "b. No" and [o.is_correct for o in first.answer_options] == [False, True]
    assert first.question_number == "1" and first.source_file == "01.html"


def test_import(spark):
    stored = question("a", topic="Pediatría")
    table = spark.createDataFrame([], S.QUESTIONS)
    now = F.lit(NEW).cast("timestamp_ntz")
    image_map = spark.createDataFrame([("u", "n")], "original_url string, hosted_url string")

    def raw(*questions):
        rows = [(q["question_id"], json.dumps(q), i, "f") for i, q in enumerate(questions)]
        return spark.createDataFrame(rows, "question_id string, json string, ordinal bigint, source_file string")

    table, quarantine, report = build_bank.import_bank(raw(stored), table, image_map, now)
    assert table.count() == 1 and quarantine.count() == 0
    incoming = raw(question("a"), question("b", images=["u"]), question("c", answer_options=[]))
    after, quarantine, report = build_bank.import_bank(incoming, table, image_map, now)
    rows = {r.question_id: r for r in after.collect()}
    assert set(rows) == {"a", "b"} and rows["a"].topic == "Pediatría" and rows["b"].images == ["n"]
    assert [r.question_id for r in quarantine.collect()] == ["c"]
    assert report.first().asDict() == {
        "valid": 1, "invalid": 1, "with_images": 1, "exam_rows": 0, "issues": 1, "skipped": 1
    }
    updated, _, _ = build_bank.import_bank(incoming, table, image_map, now, update=True)
    assert {r.question_id: r.topic for r in updated.collect()} == {"a": "Diabetes", "b": "Diabetes"}
    with pytest.raises(CheckFailed):
        build_bank.import_bank(raw(question("a"), question("a")), table, image_map, now)
