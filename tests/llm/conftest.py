import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as documents, with columns whose names clash with those of the results."""

    def make(rows):
        frame = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, hash string, size int, votes string")
        return frame

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c "),
    (4, "one"),
    (4, "one"),
    (5, "A b"),
    (None, "null id here too"),
    (6, "x" * 50_000),
    (7, "wörd 日本語   é\n" * 3000),
    (8, "The SAME line of words here.\nThe SAME line of words here.\nOther\n\n"),
    (9, "\x00 odd ퟿ chars \U0001f600"),
]


@pytest.fixture
def odd():
    return list(ODD)
