"""Growth: what a step costs or holds must follow its input, with the same results."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from recallgrid.operators import html_items
from recallgrid.operators.performance import performance
from recallgrid.streaming import answer_tree
from recallgrid.streaming import answers as stream

T0 = datetime.datetime(2024, 1, 1)


class Held:
    """A state of the state store, as a step of the stream sees it."""

    exists, row = False, None

    @property
    def get(self):
        return self.row

    def update(self, row):
        self.row, self.exists = row, True


def fold(rights):
    total = correct = streak = 0
    score = None
    for right in rights:
        total, correct, streak = total + 1, correct + right, streak + 1 if right else 0
        score = (-1.0 if right else 5.0) if score is None else min(50.0, max(-10.0, score + (-2.0 if right else 5.0)))
    return total, correct, streak, score


def test_a_step_of_the_state_store_advances_all_keys_of_a_bucket():
    rng = np.random.default_rng(5)
    state, histories = Held(), {}
    for batch in range(3):
        n = 2_000
        rows = pd.DataFrame(
            {
                "username": rng.integers(0, 40, n) + 2**53,
                "question_id": rng.integers(0, 30, n),
                "answered_at": pd.Timestamp(T0) + pd.to_timedelta(rng.permutation(n), unit="s"),
                "id": np.arange(n) + batch * n,
                "is_correct": rng.random(n) < 0.6,
                "topic": f"t{batch}",
            }
        )
        for r in rows.sort_values(["answered_at", "id"]).itertuples():
            histories.setdefault((r.username, r.question_id), ([], r.topic))[0].append(r.is_correct)
        got = pd.concat(stream._advance((0,), iter([rows[: n // 3], rows[n // 3 :]]), state))
        asked = set(zip(rows["username"], rows["question_id"]))
        assert len(got) == len(asked)
        for r in got.itertuples():
            rights, topic = histories[r.username, r.question_id]
            assert (r.total_attempts, r.correct_attempts, r.streak, r.priority_score, r.topic) == (*fold(rights), topic)


def test_a_bucket_without_learners_keeps_its_keys():
    state = Held()
    rows = pd.DataFrame(
        {"username": [None, None], "question_id": [1, 2], "answered_at": [pd.Timestamp(T0)] * 2, "id": [1, 2], "is_correct": [True, None], "topic": ["x", None]}
    )
    for n in (1, 2):
        got = pd.concat(stream._advance((1,), iter([rows]), state)).sort_values("question_id")
        assert list(got["total_attempts"]) == [n, n] and list(got["streak"]) == [n, 0]
        assert got["username"].isna().all()


def shape(node):
    return node if isinstance(node, str) else (node.tag, node.attrs, node.classes, [shape(c) for c in node.children])


def test_plain_pages_are_read_as_by_the_tolerant_parser(monkeypatch):
    item = '<html><body><DIV id="question-1-2" Class="que  multichoice"><p>a &lt; b &amp c</p></i>x<br>\n<img src="/a b.png" >'
    pages = [item, item + "</div></b>y</body></html>"]
    for odd in ("<", "<br/>", "<p a=b>", '<p a="&amp;">', "<!-- </div> -->", "<script><b></script>", "</p x>", "&eacute", "<title><b></title>", ""):
        pages += [item + odd, odd + item, item.replace("<p>", odd)]
    plain = [html_items._Tree(p) for p in pages]
    assert html_items._Tree("")._plain(pages[1]) and not html_items._Tree("")._plain(pages[2])
    monkeypatch.setattr(html_items._Tree, "_plain", lambda self, page: False)
    for page, tree in zip(pages, plain):
        tolerant = html_items._Tree(page)
        assert shape(tree.root) == shape(tolerant.root), page
        assert [(n.place, n.end) for n in tree.order] == [(n.place, n.end) for n in tolerant.order]


def test_pages_in_one_of_many_partitions_are_dealt_without_a_sort(spark):
    rows = spark.range(400).select("id", F.concat(F.lit("<p>"), F.col("id")).alias("html"))
    cores = spark.sparkContext.defaultParallelism
    for pages in (rows.coalesce(1), rows.repartition(4 * cores, F.lit(1))):
        dealt = html_items._dealt(pages, None)
        counts = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 400 and max(counts) < 100
        assert "Sort" not in dealt._jdf.queryExecution().executedPlan().toString()
    even = rows.repartition(cores, "id")
    assert html_items._dealt(even, None) is even


def test_spans_with_one_child_are_not_composed_again(spark, tmp_path, monkeypatch):
    answer = "username long, question_id long, answered_at timestamp_ntz, id long, is_correct boolean"
    log = [(i % 3, i % 2, T0 + datetime.timedelta(hours=5 * i), i, i * 7 % 5 < 3) for i in range(20)]
    calls = []
    compose = answer_tree.merge_partials
    monkeypatch.setattr(answer_tree, "merge_partials", lambda *a, **k: calls.append(1) or compose(*a, **k))
    tree = answer_tree.AnswerTree(spark, str(tmp_path / "t"), spark.createDataFrame([], answer).schema)
    tree.add(spark.createDataFrame(log, answer), 0, "s")
    # The days, and the span of 16 days above them; all higher spans have one child.
    assert len(calls) == 2
    questions = spark.createDataFrame([(0, "x"), (1, "y")], "question_id long, topic string")
    want = performance(spark.createDataFrame(log, answer), questions)
    assert sorted(tree.state(questions).collect()) == sorted(want.collect())
