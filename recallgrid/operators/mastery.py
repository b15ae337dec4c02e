"""Topic mastery per learner: two definitions of accuracy, one level rule."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.scoring import mastery_level, mastery_status, percent, stars
from recallgrid.operators.complete import first_missing, numbered, with_every
from recallgrid.operators.stats import topic_performance


def topic_mastery_levels(performance: DataFrame) -> DataFrame:
    """Levels on the mean of the questions' own accuracies (macro)."""
    own = percent(F.col("correct_attempts"), F.col("total_attempts"))
    return (
        performance.groupBy("username", "topic")
        .agg(
            F.count(F.lit(1)).alias("questions_answered"),
            # Nine digits: the mean must not depend on the order of summation.
            F.round(F.avg(own), 9).alias("accuracy"),
            F.avg("priority_score").alias("avg_priority"),
        )
        .withColumn("level", mastery_level(F.col("accuracy"), F.col("questions_answered")))
    )


def _graded(topics: DataFrame) -> DataFrame:
    accuracy, answered = F.col("accuracy"), F.col("questions_answered")
    return topics.withColumn("level", mastery_level(accuracy, answered)).select(
        "username",
        "topic",
        "level",
        stars(F.col("level")).alias("stars"),
        "accuracy",
        F.least(accuracy, F.lit(100.0)).alias("progress"),
        "questions_answered",
        mastery_status(accuracy, answered).alias("status"),
    )


def topic_masteries(performance: DataFrame) -> DataFrame:
    """Levels on accuracy over all attempts (micro), for topics with answers."""
    return _graded(topic_performance(performance))


def all_topic_masteries(
    performance: DataFrame, questions: DataFrame, users: DataFrame | None = None
) -> DataFrame:
    """As above for every topic: topics without answers stand at level 0.

    Topics found only in the performance table are kept too. Every learner
    meets every topic: for selection use ``listed_topics``.
    """
    users = performance.select("username").distinct() if users is None else users
    spine = with_every(users, questions.select("topic").distinct())
    filled = (
        spine.join(topic_performance(performance), ["username", "topic"], "full_outer")
        .withColumn("accuracy", F.coalesce("accuracy", F.lit(0.0)))
        .withColumn("questions_answered", F.coalesce("questions_answered", F.lit(0)))
    )
    return _graded(filled)


def listed_topics(
    performance: DataFrame, questions: DataFrame, users: DataFrame, n: int = 1
) -> DataFrame:
    """Levels of each learner's own topics and of the first n untouched ones by name.

    Untouched topics all stand at level 0 and accuracy 0, so among the lowest n
    topics no other untouched one can be.
    """
    own = topic_masteries(performance).select("username", "topic", "level", "accuracy")
    answered = (
        performance.select("username", "question_id")
        .join(questions.select("question_id", "topic"), "question_id")
        .select("username", "topic")
    )
    # A moved question makes its new topic one of the learner's topics, without attempts there.
    moved = answered.distinct().join(own, ["username", "topic"], "left_anti")
    mine = own.select("username", F.col("topic").alias("value")).unionByName(moved.select("username", F.col("topic").alias("value")))
    untouched = first_missing(users, mine, numbered(questions.select("topic")), n)
    at_zero = moved.unionByName(untouched.withColumnRenamed("value", "topic")).select(
        "username", "topic", mastery_level(F.lit(0.0), F.lit(0)).alias("level"), F.lit(0.0).alias("accuracy")
    )
    return own.unionByName(at_zero)


def weakest_topic(levels: DataFrame) -> DataFrame:
    """Per learner the topic with the lowest (level, accuracy)."""
    worst = F.min_by("topic", F.struct("level", "accuracy", "topic"))
    return levels.groupBy("username").agg(worst.alias("topic"))


def priority_list(performance: DataFrame, limit: int | None = None) -> DataFrame:
    """Each learner's questions by priority, the most urgent first.

    With a limit Spark keeps only the first rows of each learner before it
    shuffles; without one the list is sorted over all learners.
    """
    if limit is None:
        return performance.orderBy("username", F.desc("priority_score"), "question_id")
    order = Window.partitionBy("username").orderBy(F.desc("priority_score"), "question_id")
    return performance.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
