"""Cases of the second round: selection without caps, file order, page texts."""

import datetime
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import html_items, images, lookups, mastery, recommend, sampling
from recallgrid.sources import readers
from recallgrid.sources.storage import scratch, stored

T0 = datetime.datetime(2024, 1, 1)


def perf(spark, rows):
    """(user, question, topic, total, correct) as performance rows."""
    return spark.createDataFrame(
        [(u, q, t, n, c, n - c, T0, 0, 5.0) for u, q, t, n, c in rows],
        "username long, question_id long, topic string, total_attempts long, correct_attempts long, "
        "incorrect_attempts long, last_answered_at timestamp_ntz, streak long, priority_score double",
    )


def test_twenty_thousand_topics(spark):
    questions = spark.range(20_000).select(
        F.col("id").alias("question_id"), F.format_string("t%05d", "id").alias("topic"), F.col("id").alias("question_number")
    )
    users = spark.createDataFrame([(1,), (2,), (3,)], "username long")
    answered = perf(spark, [(1, 0, "t00000", 3, 3), (1, 1, "t00001", 3, 1), (1, 3, "t00003", 3, 3), (2, 19_999, "t19999", 1, 0)])
    weakest = mastery.weakest_topic(mastery.listed_topics(answered, questions, users))
    assert {r.username: r.topic for r in weakest.collect()} == {1: "t00002", 2: "t00000", 3: "t00000"}
    listed = mastery.listed_topics(answered, questions, users, 3).where("username = 1").select("topic").collect()
    assert sorted(r.topic for r in listed) == ["t00000", "t00001", "t00002", "t00003", "t00004", "t00005"]
    picked = recommend.topic_first_pick(users, answered, questions, "s").collect()
    assert {r.username: r.question_id for r in picked} == {1: 2, 2: 0, 3: 0}
    complete = mastery.all_topic_masteries(answered, questions, users.where("username = 1"))
    assert complete.where("username = 1").count() == 20_000
    assert lookups.by_id(questions, *range(1500)).count() == 1500


def test_a_moved_question_counts_under_its_new_topic(spark):
    questions = spark.createDataFrame([(1, "new", 1), (2, "other", 2)], "question_id long, topic string, question_number long")
    mastered = perf(spark, [(7, 1, "old", 10, 10)]).withColumn("priority_score", F.lit(-10.0)).withColumn("streak", F.lit(10).cast("long"))
    users = spark.createDataFrame([(7,)], "username long")
    topics = {r.topic: r.available for r in recommend._open_topics(users, mastered, questions, 5).collect()}
    assert topics == {"other": 1}


def test_a_null_weight_does_not_win(spark):
    items = spark.createDataFrame([(1, q, None if q == 0 else 100.0) for q in range(5)], "username long, question_id long, w double")
    picks = {sampling.weighted_choice(items, ["username"], F.col("w"), str(s)).first().question_id for s in range(8)}
    assert 0 not in picks


def test_balanced_papers_are_full(spark):
    questions = spark.createDataFrame([(i, "t", i) for i in range(30)], "question_id long, topic string, question_number long")
    weak = perf(spark, [(1, 0, "t", 2, 0), (2, 0, "t", 2, 0), (2, 1, "t", 2, 0), *[(3, i, "t", 2, 0) for i in range(9)]])
    users = spark.createDataFrame([(i,) for i in range(1, 5)], "username long")
    paper = recommend.exam_balanced(users, weak, questions, 12, "s").groupBy("username").agg(
        F.count("*").alias("n"), F.countDistinct("question_id").alias("d")
    )
    assert sorted(map(tuple, paper.collect())) == [(i, 12, 12) for i in range(1, 5)]


def test_image_names_count_from_one(spark):
    rows = spark.createDataFrame([("q1", 0, "http://h/a.png", "not_found")], "question_id string, pos int, url string, status string")
    assert images.pending_images(rows).first().storage_name == "q1_1.png"


def test_file_order_decides_between_files_of_any_size(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"question_id": "1", "topic": "old"}]')
    (tmp_path / "b.json").write_text('[{"question_id": "1", "topic": "new"}' + ', {"question_id": "2", "topic": "x"}' * 500 + "]")
    rows = readers.read_history(spark, str(tmp_path)).where("question_id = '1'")
    assert rows.agg(F.max_by("topic", "ordinal")).first()[0] == "new"


def test_only_an_absent_path_is_an_empty_lookup(spark, tmp_path):
    assert readers.read_history(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="UNSUPPORTED|scheme|FileSystem"):
        readers.read_history(spark, "nosuch://x/y").count()


def test_page_texts_and_attributes(spark):
    node = html_items._Tree("<div>PaO2 < 60 mmHg <b>x</b><script>var a=1;</script><style>p{}</style></div>").root
    assert node.text(" ") == "PaO2 < 60 mmHg x"
    page = """<a data-href="no" title="a > b" href="yes?a=1&amp;b=2">x</a><A HREF='two'>y</A><a href=three>z</a><ab href="no">"""
    frame = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    got = {r.page_id: r["values"] for r in html_items.attribute_values(frame, "a", "href", "page_id").collect()}
    assert got[1] == ["yes?a=1&b=2", "two", "three"]


def test_scratch_leaves_nothing(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    with scratch(spark):
        assert stored(spark.range(3), "some").count() == 3
        assert set(os.listdir(folder)) != before
    assert set(os.listdir(folder)) == before


def test_state_store_keeps_all_columns_over_batches(spark, tmp_path):
    from recallgrid.operators.performance import performance
    from recallgrid.streaming.answers import stateful_performance

    schema = "id long, username long, question_id long, user_answer string, is_correct boolean, answered_at timestamp_ntz, response_time_seconds int"
    rows = [(i, i % 3, i % 2, "a", (i * 7) % 5 < 3, T0 + datetime.timedelta(minutes=i), 1) for i in range(60)]
    # Three batches by time; inside each, two files whose answers interleave.
    for b in range(3):
        part = rows[b * 20 : b * 20 + 20]
        for k in range(2):
            name = tmp_path / "in" / f"{b}-{k}"
            spark.createDataFrame(part[k::2], schema).coalesce(1).write.parquet(str(name))
            for f in name.glob("part-*"):
                os.utime(f, (time.time() - 100 + 10 * b, time.time() - 100 + 10 * b))
    questions = spark.createDataFrame([(0, "x"), (1, "y")], "question_id long, topic string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in" / "*"))
    seen = []
    query = (
        stateful_performance(stream, questions)
        .writeStream.foreachBatch(lambda df, n: seen.append(df.toPandas()))
        .outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    last = pd.concat(seen).drop_duplicates(["username", "question_id"], keep="last")
    want = performance(spark.createDataFrame(rows, schema), questions).select(*last.columns).toPandas()
    key = ["username", "question_id"]
    pd.testing.assert_frame_equal(
        last.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False
    )
    assert len(seen) >= 3
