"""What to ask next, and exam papers, for all learners in one job.

Choices the original leaves open are fixed here: topics of equal level are
ordered by accuracy and name, exam papers respect their topic filter and never
repeat a question, and weights are always current.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid import schemas as S
from recallgrid.functions.randomness import uniform
from recallgrid.functions.scoring import weight_v1, weight_v2
from recallgrid.operators.mastery import listed_topics
from recallgrid.operators.sampling import (
    draw,
    index_bank,
    topic_sizes,
    uniform_picks,
    weighted_choice,
)
from recallgrid.operators.stats import topic_performance
from recallgrid.sources.storage import stored


def is_weak():
    return F.col("incorrect_attempts") > F.col("correct_attempts")


def is_mastered():
    return (F.col("streak") >= 2) & (F.col("priority_score") < -5)


def recent_questions(impressions: DataFrame, n: int = S.RECENT_QUESTIONS) -> DataFrame:
    """The questions among each learner's last n impressions."""
    return latest(impressions, n).select("username", "question_id").distinct()


def repeated_topic(
    impressions: DataFrame, questions: DataFrame, n: int = S.RECENT_TOPICS
) -> DataFrame:
    """Learners whose last n impressions all had one topic, with that topic."""
    topics = questions.select("question_id", "topic")
    return (
        latest(impressions, n)
        .join(topics, "question_id")
        .groupBy("username")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("topic").alias("topic"),
            F.max("topic").alias("_other"),
        )
        .where((F.col("n") == n) & (F.col("topic") == F.col("_other")))
        .select("username", "topic")
    )


def latest(impressions: DataFrame, n: int) -> DataFrame:
    """Each learner's last n impressions."""
    newest = Window.partitionBy("username").orderBy(F.desc("shown_at"), F.desc("id"))
    return (
        impressions.withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= n)
        .drop("_age")
    )


def adaptive_weights(
    performance: DataFrame, questions: DataFrame, users: DataFrame, version: int = 1
) -> DataFrame:
    """Selection weights in compact form.

    One row per answered question, and per learner one row without question_id
    that stands for all other questions of the bank: they share its weight.
    """
    if version == 1:
        answered, unseen = weight_v1(F.col("priority_score")), S.WEIGHT_UNSEEN_V1
        no_history = S.WEIGHT_NO_HISTORY
    else:
        answered, unseen = weight_v2(F.col("priority_score")), S.WEIGHT_UNSEEN_V2
        no_history = S.WEIGHT_UNSEEN_V2
    one = F.lit(1).cast("bigint")
    own = performance.join(questions.select("question_id"), "question_id", "left_semi").select(
        "username", "question_id", answered.alias("weight"), one.alias("n_questions")
    )
    size = questions.agg(F.count(F.lit(1))).scalar()
    # A learner with answers to questions outside the bank still has a history.
    history = performance.select("username").distinct().withColumn("_any", F.lit(True))
    seen = own.groupBy("username").agg(F.count(F.lit(1)).alias("_n"))
    rest = (
        users.select("username")
        .join(history, "username", "left")
        .join(seen, "username", "left")
        .select(
            "username",
            F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"),
            F.when(F.col("_any"), unseen).otherwise(no_history).alias("weight"),
            (size - F.coalesce("_n", F.lit(0))).alias("n_questions"),
        )
    )
    return own.unionByName(rest)


def random_pick(users: DataFrame, questions: DataFrame, seed: str) -> DataFrame:
    """One question per learner, uniform over the bank."""
    return _random(users, index_bank(questions), seed)


def _random(users, index, seed):
    size = index.agg(F.count(F.lit(1))).scalar()
    return uniform_picks(users, size, 1, seed).join(index, "pos").select("username", "question_id")


def _else_random(users, picked, index, seed):
    """Fill in a random question for learners without a pick."""
    picked = stored(picked.select("username", "question_id"), "picked")
    missing = users.select("username").join(picked, "username", "left_anti")
    return picked.unionByName(_random(missing, index, seed))


def unanswered_pick(
    users: DataFrame, answered: DataFrame, questions: DataFrame, seed: str
) -> DataFrame:
    """A question the learner has never answered, else a random one."""
    index = index_bank(questions)
    size = index.agg(F.count(F.lit(1))).scalar()
    known = answered.join(index, "question_id").select(
        "username", F.col("pos").alias("place"), F.lit(None).cast("double").alias("weight")
    )
    targets = users.select(
        "username", size.alias("size"), F.lit(1).alias("picks"), F.lit(1.0).alias("free_weight")
    )
    places = draw(targets, known, ["username"], 1, seed)
    picked = places.join(index, places["place"] == index["pos"]).select("username", "question_id")
    return _else_random(users, picked, index, seed + "/random")


def weakest_pick(
    users: DataFrame, performance: DataFrame, questions: DataFrame, seed: str
) -> DataFrame:
    """A question more often wrong than right, else a random one."""
    index = index_bank(questions)
    weak = performance.where(is_weak()).join(index, "question_id", "left_semi")
    picked = weighted_choice(weak, ["username"], F.lit(1.0), seed)
    return _else_random(users, picked, index, seed + "/random")


def pick_within_topic(
    pairs: DataFrame, performance: DataFrame, questions: DataFrame, seed: str
) -> DataFrame:
    """One weighted draw for each given (learner, topic)."""
    index = index_bank(questions)
    keys = ["username", "topic"]
    known = (
        performance.drop("topic")
        .join(index, "question_id")
        .select(*keys, F.col("idx").alias("place"), weight_v2(F.col("priority_score")).alias("weight"))
        .join(pairs.select(*keys), keys, "left_semi")
    )
    sizes = topic_sizes(questions).select("topic", F.col("n").alias("size"))
    targets = (
        pairs.select(*keys)
        .join(sizes, "topic")
        .withColumns({"picks": F.lit(1), "free_weight": F.lit(S.WEIGHT_UNSEEN_V2)})
    )
    places = draw(targets, known, keys, 1, seed).withColumnRenamed("place", "idx")
    return places.join(index, ["topic", "idx"]).select("username", "topic", "question_id")


def _open_topics(users, performance, questions, n=1):
    """Topics a learner may be asked from, with how many questions are left.

    Of the untouched topics only the first n by name: each has a question.
    """
    mastered = (
        performance.where(is_mastered())
        .select("username", "question_id")
        .join(questions.select("question_id", "topic"), "question_id")
        .groupBy("username", "topic")
        .agg(F.count(F.lit(1)).alias("n_mastered"))
    )
    sizes = topic_sizes(questions).select("topic", F.col("n").alias("size"))
    return (
        listed_topics(performance, questions, users, n)
        .where(F.col("level") < 5)
        .join(sizes, "topic")
        .join(mastered, ["username", "topic"], "left")
        .withColumn("available", F.col("size") - F.coalesce("n_mastered", F.lit(0)))
        .where(F.col("available") > 0)
        .select("username", "topic", "level", "accuracy", "size", "available")
    )


def _topic_weights(performance, index):
    """Answered questions by place in their topic; mastered ones may not be drawn."""
    weight = F.when(~is_mastered(), weight_v2(F.col("priority_score")))
    return (
        performance.drop("topic")
        .join(index, "question_id")
        .select("username", "topic", F.col("idx").alias("place"), weight.alias("weight"))
    )


def topic_first_pick(
    users: DataFrame, performance: DataFrame, questions: DataFrame, seed: str
) -> DataFrame:
    """Weighted draw in the learner's weakest topic that has questions left."""
    keys = ["username", "topic"]
    order = F.struct("level", "accuracy", "topic")
    targets = (
        _open_topics(users, performance, questions)
        .groupBy("username")
        .agg(F.min_by(F.struct("topic", "size"), order).alias("t"))
        .select(
            "username",
            "t.topic",
            "t.size",
            F.lit(1).alias("picks"),
            F.lit(S.WEIGHT_UNSEEN_V2).alias("free_weight"),
        )
    )
    targets = stored(targets, "targets")
    index = index_bank(questions)
    known = _topic_weights(performance, index).join(targets.select(*keys), keys, "left_semi")
    places = draw(targets, known, keys, 1, seed).withColumnRenamed("place", "idx")
    picked = places.join(index, ["topic", "idx"])
    return _else_random(users, picked, index, seed + "/random")


def next_question(
    users: DataFrame,
    performance: DataFrame,
    questions: DataFrame,
    seed: str,
    mode: str = "adaptive",
    topic: str | None = None,
) -> DataFrame:
    """The mode switch: random, unanswered, weakest or adaptive."""
    if topic is not None:
        questions = questions.where(F.col("topic") == topic)
    if mode == "random":
        return random_pick(users, questions, seed)
    if mode == "unanswered":
        return unanswered_pick(users, performance.select("username", "question_id"), questions, seed)
    if mode == "weakest":
        return weakest_pick(users, performance, questions, seed)
    if topic is not None:
        pairs = users.select("username", F.lit(topic).alias("topic"))
        return pick_within_topic(pairs, performance, questions, seed).drop("topic")
    return topic_first_pick(users, performance, questions, seed)


def adaptive_pick(
    users: DataFrame,
    performance: DataFrame,
    impressions: DataFrame,
    questions: DataFrame,
    seed: str,
    topic: str | None = None,
) -> DataFrame:
    """Session pick: skip what was just shown, vary topics, draw by weight v1.

    Without a topic, a learner who saw one topic three times in a row and
    masters it (accuracy over 60) is moved to other topics with probability 0.8.
    """
    bank = questions if topic is None else questions.where(F.col("topic") == topic)
    index = index_bank(bank)
    size = index.agg(F.count(F.lit(1))).scalar()

    shown = stored(recent_questions(impressions).join(index, "question_id"), "shown")
    per_user = shown.groupBy("username").agg(F.count(F.lit(1)).alias("n_shown"))
    base = (
        users.select("username")
        .join(per_user, "username", "left")
        .withColumn("n_shown", F.coalesce("n_shown", F.lit(0)))
        .withColumn("skip_shown", size - F.col("n_shown") >= S.MIN_CANDIDATES)
    )
    if topic is None:
        accuracy = topic_performance(performance).select("username", "topic", "accuracy")
        sizes = topic_sizes(bank).select("topic", "n", "start")
        tired = (
            repeated_topic(impressions, questions)
            .join(accuracy, ["username", "topic"])
            .where(F.col("accuracy") > S.DIVERSITY_ACCURACY)
            .where(uniform(seed + "/coin", "username") < S.DIVERSITY_PROBABILITY)
            .join(sizes, "topic")
        )
        shown_elsewhere = (
            shown.join(tired.select("username", F.col("topic").alias("_avoid")), "username")
            .where(F.col("topic") != F.col("_avoid"))
            .groupBy("username")
            .agg(F.count(F.lit(1)).alias("n_elsewhere"))
        )
        base = (
            base.join(tired.select("username", F.col("topic").alias("avoid"), "n", "start"), "username", "left")
            .join(shown_elsewhere, "username", "left")
            .withColumn(
                "_others",
                size
                - F.col("n")
                - F.when(F.col("skip_shown"), F.coalesce("n_elsewhere", F.lit(0))).otherwise(0),
            )
            .withColumn("avoid", F.when(F.col("_others") > 0, F.col("avoid")))
            .withColumn("gap", F.when(F.col("avoid").isNotNull(), F.col("n")).otherwise(0))
            .withColumn("gap_at", F.when(F.col("avoid").isNotNull(), F.col("start")))
        )
    else:
        base = base.withColumns(
            {
                "avoid": F.lit(None).cast("string"),
                "gap": F.lit(0).cast("bigint"),
                "gap_at": F.lit(None).cast("bigint"),
            }
        )

    base = stored(base, "learners")
    weights = performance.select("username", "question_id", weight_v1(F.col("priority_score")).alias("weight"))
    listed = (
        weights.join(index, "question_id")
        .join(shown.select("username", "question_id", F.lit(True).alias("_shown")), ["username", "question_id"], "full_outer")
        .select("username", "question_id", "weight", F.coalesce("_shown", F.lit(False)).alias("_shown"))
        .join(index, "question_id")
        .join(base, "username")
        .where(F.col("avoid").isNull() | (F.col("topic") != F.col("avoid")))
        # When shown questions are allowed again, only answered ones need listing.
        .where(F.col("weight").isNotNull() | F.col("skip_shown"))
    )
    after_gap = F.col("gap_at").isNotNull() & (F.col("pos") >= F.col("gap_at"))
    known = listed.select(
        "username",
        F.when(after_gap, F.col("pos") - F.col("gap")).otherwise(F.col("pos")).alias("place"),
        F.when(~(F.col("_shown") & F.col("skip_shown")), F.col("weight")).alias("weight"),
    )
    targets = base.select(
        "username",
        (size - F.col("gap")).alias("size"),
        F.lit(1).alias("picks"),
        F.lit(S.WEIGHT_UNSEEN_V1).alias("free_weight"),
    )
    places = draw(targets, known, ["username"], 1, seed).join(
        base.select("username", "gap", "gap_at"), "username"
    )
    moved = F.col("gap_at").isNotNull() & (F.col("place") >= F.col("gap_at"))
    return (
        places.withColumn("pos", F.when(moved, F.col("place") + F.col("gap")).otherwise(F.col("place")))
        .join(index, "pos")
        .select("username", "question_id")
    )


def exam_mixed(
    users: DataFrame, questions: DataFrame, n: int, seed: str, topics: list[str] | None = None
) -> DataFrame:
    """n different questions per learner, uniform over the chosen topics."""
    bank = _in_topics(questions, topics)
    index = index_bank(bank)
    size = index.agg(F.count(F.lit(1))).scalar()
    return (
        uniform_picks(users, size, n, seed)
        .join(index, "pos")
        .select("username", "rank", "question_id")
    )


def exam_challenging(
    users: DataFrame,
    performance: DataFrame,
    questions: DataFrame,
    n: int,
    seed: str,
    topics: list[str] | None = None,
) -> DataFrame:
    """n adaptive picks: the weakest topic first, then the next one.

    Learners with fewer open questions than n get the rest uniformly from what
    is left of the bank.
    """
    bank = _in_topics(questions, topics)
    known_users = performance.join(bank.select("question_id"), "question_id", "left_semi")
    keys = ["username", "topic"]
    in_order = Window.partitionBy("username").orderBy("level", "accuracy", "topic")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    targets = (
        _open_topics(users, known_users, bank, n)
        .withColumn("turn", F.row_number().over(in_order))
        .withColumn("taken", F.coalesce(F.sum("available").over(earlier), F.lit(0)))
        .where(F.col("taken") < n)
        .select(
            *keys,
            "turn",
            "size",
            F.least(F.col("available"), n - F.col("taken")).alias("picks"),
            F.lit(S.WEIGHT_UNSEEN_V2).alias("free_weight"),
        )
    )
    targets = stored(targets, "targets")
    index = index_bank(bank)
    known = _topic_weights(known_users, index).join(targets.select(*keys), keys, "left_semi")
    places = draw(targets, known, keys, n, seed).withColumnRenamed("place", "idx")
    picked = stored(
        places.join(index, ["topic", "idx"]).select("username", "question_id", "pos"), "picked"
    )
    return picked.select("username", "question_id").unionByName(
        _fill_up(users, picked, index, n, seed + "/fill")
    )


def exam_balanced(
    users: DataFrame,
    performance: DataFrame,
    questions: DataFrame,
    n: int,
    seed: str,
    topics: list[str] | None = None,
) -> DataFrame:
    """Up to a third weak questions, the rest random without repeating them; papers are full."""
    bank = _in_topics(questions, topics)
    index = index_bank(bank)
    size = index.agg(F.count(F.lit(1))).scalar()
    total = F.least(F.lit(n).cast("bigint"), size)
    n_weak = F.floor(total / 3).cast("bigint")
    hashed = Window.partitionBy("username").orderBy(
        uniform(seed + "/weak", "username", "question_id"), "question_id"
    )
    weak = (
        performance.where(is_weak())
        .select("username", "question_id")
        .join(index, "question_id")
        .withColumn("rank", F.row_number().over(hashed))
        .where(F.col("rank") <= n // 3)
        .where(F.col("rank") <= n_weak)
        .select("username", "question_id", "pos")
    )
    weak = stored(weak, "weak")
    has_weak = weak.groupBy("username").agg(F.count(F.lit(1)).alias("n_picked"))
    wanted = (
        users.select("username")
        .join(has_weak, "username", "left")
        .select(
            "username",
            (total - F.coalesce("n_picked", F.lit(0))).alias("picks"),
        )
    )
    rest = _draw_rest(wanted, weak, index, n, seed + "/rest")
    return weak.select("username", "question_id").unionByName(rest)


def _fill_up(users, picked, index, n, seed):
    """Uniform picks for learners who have fewer questions than wanted."""
    have = picked.groupBy("username").agg(F.count(F.lit(1)).alias("_have"))
    missing = (
        users.select("username")
        .join(have, "username", "left")
        .withColumn("picks", F.lit(n) - F.coalesce("_have", F.lit(0)))
        .where(F.col("picks") > 0)
        .select("username", "picks")
    )
    return _draw_rest(missing, picked, index, n, seed)


def _draw_rest(wanted, picked, index, n, seed):
    """Uniform draw from the bank without the questions already picked."""
    picked = picked.select("username", "question_id", "pos")
    size = index.agg(F.count(F.lit(1))).scalar()
    targets = stored(
        wanted.select("username", size.alias("size"), "picks", F.lit(1.0).alias("free_weight")),
        "targets",
    )
    known = picked.join(targets.select("username"), "username", "left_semi").select(
        "username", F.col("pos").alias("place"), F.lit(None).cast("double").alias("weight")
    )
    places = draw(targets, known, ["username"], n, seed)
    return places.join(index, places["place"] == index["pos"]).select("username", "question_id")


def _in_topics(questions: DataFrame, topics: list[str] | None) -> DataFrame:
    return questions if topics is None else questions.where(F.col("topic").isin(topics))
