"""Compare plan shapes on the same data: python tools/plan_shapes.py [sf_dir] [name ...]

Each pair gives the same answer; the first is the obvious plan, the second the
one the library uses.
"""

import os
import statistics
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from recallgrid.functions.randomness import uniform  # noqa: E402
from recallgrid.operators import classify, recommend, stats  # noqa: E402
from recallgrid.operators.performance import performance  # noqa: E402
from recallgrid.plans import derived  # noqa: E402
from recallgrid.plans import fixtures as X  # noqa: E402
from recallgrid.sources.storage import stored  # noqa: E402


def seconds(job, runs=2):
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return statistics.median(times[1:])


def three_pass_histogram(classified):
    low, high = F.col("confidence") < 0.5, F.col("confidence") >= 0.8
    parts = [classified.where(c).agg(F.count(F.lit(1)).alias("n")) for c in (low, high, ~low & ~high)]
    return parts[0].union(parts[1]).union(parts[2])


def listed_pairs_draw(users, answered, questions):
    pairs = users.crossJoin(questions.select("question_id")).join(
        answered, ["username", "question_id"], "left_anti"
    )
    return pairs.groupBy("username").agg(F.min_by("question_id", uniform("s", "username", "question_id")))


def list_fold(answers, questions):
    history = answers.groupBy("username", "question_id").agg(
        F.array_sort(F.collect_list(F.struct("answered_at", "id", "is_correct"))).alias("h")
    )

    def step(score, a):
        first = F.when(a["is_correct"], -1.0).otherwise(5.0)
        later = F.when(a["is_correct"], F.greatest(score - 2.0, F.lit(-10.0))).otherwise(
            F.least(score + 5.0, F.lit(50.0))
        )
        return F.when(score.isNull(), first).otherwise(later)

    score = F.reduce("h", F.lit(None).cast("double"), step)
    return history.select("username", "question_id", score.alias("priority_score")).join(
        questions.select("question_id", "topic"), "question_id"
    )


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    q, a = X.questions(spark, sf), X.answers(spark, sf)
    users, answered = stats.learners(a), stats.answered_questions(a)
    # One key holds every answer: what a very active key does to either fold.
    hot = stored(X.dense(a).withColumns({"username": F.lit(1), "question_id": F.lit(1)}), "hot")
    classified = classify.parse_responses(derived.responses(spark, sf))
    pairs = {
        "confidence histogram": (
            lambda: three_pass_histogram(classified),
            lambda: stats.confidence_histogram(classified),
        ),
        "unanswered draw": (
            lambda: listed_pairs_draw(users, answered, q),
            lambda: recommend.unanswered_pick(users, answered, q, "s"),
        ),
        "fold, many keys": (lambda: list_fold(a, q), lambda: performance(a, q)),
        "fold, one key": (lambda: list_fold(hot, q), lambda: performance(hot, q)),
    }
    for name in sys.argv[2:] or pairs:
        obvious, used = pairs[name]
        print(f"{name}: obvious {seconds(obvious):.2f} s, used {seconds(used):.2f} s", flush=True)


if __name__ == "__main__":
    main()
