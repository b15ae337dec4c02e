"""Quality of documents from rules that vote or abstain, without labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import batch_of, bounded_batches, texts
from recallgrid.sources.storage import stored

_SYMBOL = re.compile(r"[#*$%&|<>]")
_NO_LETTER = re.compile(r"[\W\d_]+", re.ASCII)
_UPPER = re.compile(rb"[A-Z]")
_LOWER = re.compile(rb"[a-z]")
_DIGIT = re.compile(rb"[0-9]")
_SHOUT = re.compile(rb"!!")

#: Rules: name, feature, votes good at or below the first figure, bad at or
#: above the second, abstains between them.
RULES = [
    ("symbols", "symbol_rate", 0.05, 0.3),
    ("repeats", "repeat_rate", 0.2, 0.5),
    ("duplicate_lines", "dup_line_rate", 0.2, 0.5),
    ("capitals", "capital_rate", 0.2, 0.6),
    ("shouting", "shout_rate", 0.02, 0.3),
    ("digits", "digit_rate", 0.05, 0.2),
    ("no_letters", "no_letter_rate", 0.1, 0.3),
    ("long_words", "word_length", 7.0, 12.0),
    ("short_words", "shortness", 0.33, 0.45),
]

FEATURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
    "n_small",
    "n_digits",
    "n_shouts",
    "n_no_letters",
]


def repeated_words(words: list) -> int:
    """Words that stand in a 3-word window found twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    base = len(number)
    if base < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pairs = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)
        _, windows = np.unique(pairs * base + ids[2:], return_inverse=True)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def measured(data: bytes) -> tuple[int, ...]:
    """The FEATURES of one text."""
    text, words = data.decode("utf-8", "replace"), data.split()
    n_space = len(data) - sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(text) - n_space,
        len(_SYMBOL.findall(text)),
        sum(n - 1 for n in Counter(lines).values()),
        repeated_words(words),
        len(lines),
        len(_UPPER.findall(data)),
        len(_LOWER.findall(data)),
        len(_DIGIT.findall(data)),
        len(_SHOUT.findall(data)),
        sum(1 for w in words if w.isascii() and not w.isalpha() and _NO_LETTER.fullmatch(w.decode())),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in FEATURES)])
    for batch in batches:
        rows = [measured(x) for x in texts(batch)]
        yield batch_of(schema, [batch.column(0), *(list(zip(*rows, strict=True)) or [()] * len(FEATURES))])


def measurements(docs: DataFrame) -> DataFrame:
    """The FEATURES of each document's whole text; a null text is empty."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _measure, "doc_id long, " + ", ".join(f"{n} long" for n in FEATURES)
    )


def _rates() -> dict:
    words = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.greatest(F.col("n_capitals") + F.col("n_small"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "repeat_rate": F.col("n_repeat_words") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "capital_rate": F.col("n_capitals") / letters,
        "shout_rate": F.col("n_shouts") / words,
        "digit_rate": F.col("n_digits") / chars,
        "no_letter_rate": F.col("n_no_letters") / words,
        "word_length": F.col("word_chars") / words,
        "shortness": F.col("n_words") / chars,
    }


def votes(measures: DataFrame) -> DataFrame:
    """Adds votes: one digit a rule, 2 good, 0 bad, 1 abstains. Texts without a word abstain throughout."""
    rates = _rates()
    digits = [
        F.when(F.col("n_words") == 0, "1")
        .when(rates[feature] <= good, "2")
        .when(rates[feature] >= bad, "0")
        .otherwise("1")
        for _, feature, good, bad in RULES
    ]
    return measures.withColumn("votes", F.concat(*digits))


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns.

    patterns: (n, rules) of 0, 1, 2; counts: documents of each pattern.
    Starts from a suspicion against every document with a vote for "bad", as
    most rules find nothing to object to in most bad documents: a majority
    would drown the one that does. Each rule has, for good and for bad
    documents, a distribution over its three votes (one count of smoothing).
    Returns the posterior of "good" by pattern, the accuracies (how often each
    rule that votes is right) and the share of good documents.
    """
    n_rules = patterns.shape[1]
    posterior = np.where((patterns == 0).any(1), 0.05, 0.95)
    hot = np.stack([patterns == v for v in range(3)], 2).astype(float)
    share = 0.9
    table = np.full((2, n_rules, 3), 1 / 3)
    for _ in range(rounds):
        weights = np.stack([counts * (1 - posterior), counts * posterior])
        table = np.einsum("cn,nrv->crv", weights, hot) + 1.0
        table /= table.sum(2, keepdims=True)
        # A rule is better than chance: a vote for "good" is likelier on good documents.
        swap = table[1, :, 2] * table[0, :, 0] < table[0, :, 2] * table[1, :, 0]
        table[:, swap] = table[:, swap].mean(0, keepdims=True)
        share = (weights[1].sum() + 1) / (weights.sum() + 2)
        score = np.einsum("crv,nrv->cn", np.log(table), hot) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    right = (share * table[1, :, 2] + (1 - share) * table[0, :, 0]) / (
        share * (table[1, :, 2] + table[1, :, 0]) + (1 - share) * (table[0, :, 0] + table[0, :, 2])
    )
    return posterior, right, float(share)


def quality(docs: DataFrame, least_posterior: float = 0.5) -> DataFrame:
    """Posterior probability that each document is good, from voting rules.

    docs: doc_id long, text string; other columns are not read. Every text is
    measured once; the votes are counted by pattern over all documents (at
    most 3 ** len(RULES) = 19,683 patterns, which is the bound of what reaches
    the driver and of the broadcast), expectation-maximisation estimates the
    rules' accuracies and the posterior of each pattern. kept: not base_failed
    and posterior >= least_posterior.

    Null or empty text: all counts 0, base_failed. A text whose rules all
    abstain gets the share of good documents. Repeated rows: one row each, and
    each counts. Empty table: no rows.
    """
    spark = docs.sparkSession
    cast = stored(votes(measurements(docs)), "votes")
    n = [(tuple(int(v) for v in r["votes"]), r["count"]) for r in cast.groupBy("votes").count().collect()]
    n.sort()
    patterns = np.array([p for p, _ in n], int).reshape(len(n), len(RULES))
    posterior, _, _ = accuracies(patterns, np.array([c for _, c in n], float))
    judged = spark.createDataFrame(
        [("".join(map(str, p)), float(q)) for (p, _), q in zip(n, posterior, strict=True)],
        "votes string, posterior double",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        cast.join(F.broadcast(judged), "votes")
        .withColumn("base_failed", failed)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & (F.col("posterior") >= least_posterior)).alias("kept"),
            "votes",
            F.col("posterior").alias("quality_posterior"),
        )
    )
