"""Draws: frequencies over many seeds, exclusions, no repeats."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import recommend, sampling

PERF = (
    "username string, question_id bigint, topic string, total_attempts bigint, correct_attempts bigint, "
    "incorrect_attempts bigint, streak bigint, priority_score double"
)


@pytest.fixture(scope="module")
def bank(spark):
    rows = [(i, "abc"[i % 3], f"{i}") for i in range(12)]
    return spark.createDataFrame(rows, "question_id bigint, topic string, question_number string")


def many_users(spark, n):
    return spark.range(n).select(F.concat(F.lit("u"), "id").alias("username"))


def close(counts, weights, n):
    """Every frequency within five standard deviations of its expectation."""
    total = sum(weights.values())
    for item, w in weights.items():
        p = w / total
        assert abs(counts.get(item, 0) - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1, (item, counts)
    assert set(counts) <= {i for i, w in weights.items() if w > 0}


def test_weighted_choice_frequencies(spark):
    n = 4000
    weights = {1: 1.0, 2: 3.0, 3: 0.5, 4: 0.0}
    rows = spark.createDataFrame(list(weights.items()), "question_id bigint, w double")
    items = many_users(spark, n).withColumn("question_id", F.explode(F.array(*[F.lit(k) for k in weights])))
    items = items.join(rows, "question_id")
    picked = sampling.weighted_choice(items, ["username"], F.col("w"), "s")
    close(Counter(r.question_id for r in picked.collect()), weights, n)


def test_zero_weights_are_uniform(spark):
    n = 3000
    items = many_users(spark, n).withColumn("question_id", F.explode(F.array(F.lit(1), F.lit(2))))
    picked = sampling.weighted_choice(items, ["username"], F.lit(0.0), "s")
    close(Counter(r.question_id for r in picked.collect()), {1: 1, 2: 1}, n)


def test_draw_frequencies(spark):
    """Listed questions with own weights against unlisted ones with a common weight."""
    n = 4000
    users = many_users(spark, n)
    targets = users.select(
        "username", F.lit(8).alias("size"), F.lit(1).alias("picks"), F.lit(3.0).alias("free_weight")
    )
    known = users.select("username", F.explode(F.array(F.lit(1), F.lit(2), F.lit(6))).alias("place")).withColumn(
        "weight", F.when(F.col("place") == 1, 7.0).when(F.col("place") == 6, 0.5)
    )
    places = sampling.draw(targets, known, ["username"], 1, "s")
    weights = {0: 3, 1: 7, 2: 0, 3: 3, 4: 3, 5: 3, 6: 0.5, 7: 3}
    close(Counter(r.place for r in places.collect()), weights, n)


def test_draw_without_replacement(spark):
    n = 1500
    users = many_users(spark, n)
    targets = users.select(
        "username", F.lit(6).alias("size"), F.lit(4).alias("picks"), F.lit(2.0).alias("free_weight")
    )
    known = users.select("username", F.lit(3).alias("place"), F.lit(None).cast("double").alias("weight"))
    rows = sampling.draw(targets, known, ["username"], 4, "s").collect()
    per_user = {}
    for r in rows:
        per_user.setdefault(r.username, set()).add(r.place)
    assert len(per_user) == n and all(len(p) == 4 and 3 not in p for p in per_user.values())
    close(Counter(p for ps in per_user.values() for p in ps), dict.fromkeys([0, 1, 2, 4, 5], 1), 4 * n)


def test_places_in_large_pool(spark, monkeypatch):
    """Resolving places block by block agrees with listing them."""
    monkeypatch.setattr(sampling, "_BLOCK", 8)
    listed = [p for p in range(200) if p % 3 != 0 or 60 <= p < 90]
    free = [p for p in range(200) if p not in listed]
    known = spark.createDataFrame([("u", p) for p in listed], "username string, place bigint")
    winners = spark.createDataFrame(
        [("u", None, j, j + 1) for j in range(len(free))],
        "username string, place bigint, free_place bigint, rank bigint",
    )
    found = sampling._resolve_free_places(winners, known, ["username"]).collect()
    assert [p for _, p in sorted((r.rank, r.place) for r in found)] == free


def test_index_counts_without_gaps(spark, bank):
    rows = sampling.index_bank(bank).collect()
    assert sorted(r.pos for r in rows) == list(range(12))
    for topic in "abc":
        assert sorted(r.idx for r in rows if r.topic == topic) == list(range(4))


def test_uniform_sample(spark, bank):
    assert sampling.sample(bank, 5, "s").select("question_id").distinct().count() == 5
    n = 1200
    picks = sampling.uniform_picks(many_users(spark, n), F.lit(12), 3, "s").collect()
    assert len({(r.username, r.pos) for r in picks}) == 3 * n
    close(Counter(r.pos for r in picks), dict.fromkeys(range(12), 1), 3 * n)


def perf_rows(spark, rows):
    return spark.createDataFrame(rows, PERF)


def test_weights(spark, bank):
    perf = perf_rows(
        spark,
        [("u", i, "a", 1, 0, 1, 0, p) for i, p in enumerate([7.0, 0.05, 0.0, -4.0, -10.0])],
    )
    users = spark.createDataFrame([("u",), ("new",)], "username string")
    v1 = {(r.username, r.question_id): (r.weight, r.n_questions) for r in recommend.adaptive_weights(perf, bank, users, 1).collect()}
    assert [v1["u", i][0] for i in range(5)] == [7.0, 0.1, 0.5, 0.5, 0.5]
    assert v1["u", None] == (5.0, 7) and v1["new", None] == (1.0, 12)
    v2 = {(r.username, r.question_id): r.weight for r in recommend.adaptive_weights(perf, bank, users, 2).collect()}
    assert [round(v2["u", i], 6) for i in range(5)] == [7.0, 0.05, 0.5, 0.9, 1.5]
    assert v2["u", None] == 3.0


@pytest.fixture(scope="module")
def learners(spark):
    """all: everything answered; good: topics a and b mastered item by item; new: nothing."""
    rows = [("all", i, "abc"[i % 3], 3, 0, 3, 0, 15.0) for i in range(12)]
    rows += [("good", i, "abc"[i % 3], 5, 5, 0, 5, -9.0) for i in range(12) if i % 3 < 2]
    users = spark.createDataFrame([("all",), ("good",), ("new",)], "username string")
    return users, perf_rows(spark, rows)


def test_modes(spark, bank, learners):
    users, perf = learners
    for mode in ("random", "unanswered", "weakest", "adaptive"):
        for topic in (None, "b"):
            rows = recommend.next_question(users, perf, bank, "s", mode, topic).collect()
            found = {r.username: r.question_id for r in rows}
            assert set(found) == {"all", "good", "new"}, mode
            if topic:
                assert all(q % 3 == 1 for q in found.values()), mode
    found = {r.username: r.question_id for r in recommend.next_question(users, perf, bank, "s", "adaptive").collect()}
    assert found["good"] % 3 == 2
    found = {r.username: r.question_id for r in recommend.next_question(users, perf, bank, "s", "unanswered").collect()}
    assert found["good"] % 3 == 2


def test_exam_papers(spark, bank, learners):
    users, perf = learners
    papers = {
        "mixed": recommend.exam_mixed(users, bank, 9, "s"),
        "challenging": recommend.exam_challenging(users, perf, bank, 9, "s"),
        "balanced": recommend.exam_balanced(users, perf, bank, 9, "s"),
        "too long": recommend.exam_challenging(users, perf, bank, 50, "s"),
        "few topics": recommend.exam_challenging(users, perf, bank, 9, "s", ["a", "c"]),
    }
    sizes = {"too long": 12, "few topics": 8}
    for name, paper in papers.items():
        rows = [(r.username, r.question_id) for r in paper.collect()]
        assert len(set(rows)) == len(rows) == 3 * sizes.get(name, 9), name
    hard = [r.question_id for r in papers["challenging"].where("username = 'good'").collect()]
    assert {q for q in range(12) if q % 3 == 2} <= set(hard)


def test_session_pick(spark, bank):
    """Nothing just shown; mastered repeated topics are mostly left; few questions lift the ban."""
    n = 400
    users = many_users(spark, n)
    shown = users.select(
        "username", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(t).alias("t")) for t, q in enumerate([3, 6, 0])])).alias("s")
    ).select(
        F.col("s.t").cast("bigint").alias("id"),
        "username",
        F.col("s.q").cast("bigint").alias("question_id"),
        F.timestamp_seconds("s.t").alias("shown_at"),
    )
    perf = users.select("username", F.explode(F.array(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("question_id")).select(
        "username", "question_id", F.lit("a").alias("topic"), F.lit(2).cast("bigint").alias("total_attempts"),
        F.lit(2).cast("bigint").alias("correct_attempts"), F.lit(0).cast("bigint").alias("incorrect_attempts"),
        F.lit(2).cast("bigint").alias("streak"), F.lit(-3.0).alias("priority_score"),
    )
    picked = Counter(r.question_id for r in recommend.adaptive_pick(users, perf, shown, bank, "s").collect())
    assert sum(picked.values()) == n
    assert not {0, 3, 6} & set(picked)
    # Question 9 is all that is left of topic a: drawn in at most a fifth of the cases.
    assert picked[9] < n * 0.1
    few = bank.where("question_id in (0, 3, 6, 9)")
    again = Counter(r.question_id for r in recommend.adaptive_pick(users, perf, shown, few, "s").collect())
    assert {6, 9} <= set(again) and sum(again.values()) == n
    in_topic = recommend.adaptive_pick(users, perf, shown, bank, "s", "b").collect()
    assert len(in_topic) == n and all(r.question_id % 3 == 1 for r in in_topic)
