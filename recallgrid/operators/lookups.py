"""Reading parts of the question bank."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_topics(questions: DataFrame, *topics: str) -> DataFrame:
    """Questions of one or more topics in the order of their number."""
    return questions.where(F.col("topic").isin(*topics)).orderBy("question_number", "question_id")


def by_id(questions: DataFrame, *ids) -> DataFrame:
    """Questions by id; the filter reaches the scan. Ids of a table go to ``by_ids``."""
    return questions.where(F.col("question_id").isin(*ids))


def by_ids(questions: DataFrame, ids: DataFrame) -> DataFrame:
    return questions.join(ids.select("question_id").distinct(), "question_id", "left_semi")


def with_images(questions: DataFrame) -> DataFrame:
    return questions.where(F.size("images") > 0)


def rename_category(classified: DataFrame, column: str = "category") -> DataFrame:
    """The category replaces the topic."""
    return classified.withColumn("topic", F.col(column)).drop(column)


def first_rows(questions: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    """The head of a file, for trial runs of a job."""
    return questions.orderBy(order).limit(n)
