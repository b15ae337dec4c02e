"""Learner state per (user, question): attempts, streak and priority score.

Priority depends on answer order, because every step is clamped. One step maps
a score ``x`` to ``min(hi, max(lo, x + add))``, and two such maps in a row are
again one map of that form. So a history can be cut anywhere, its pieces folded
apart and the pieces composed in time order:

1. range-partition the answers by (user, question, time, id) - this also cuts
   the history of a very active key over many tasks - and sort each partition;
2. fold every run of equal keys to one partial row (Arrow batches, numpy);
3. compose the few partials of each key in time order (JVM).

No step holds the whole history of a key. Partials of separate days or stream
batches can be stored and composed later, which gives incremental refresh.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid import schemas as S
from recallgrid.sources.storage import stored

KEY = ["username", "question_id"]
ORDER = ["answered_at", "id"]
FIRST = ("first_at", "first_id")

_SUMMARY_FIELDS = [
    T.StructField("first_id", T.LongType()),
    T.StructField("first_correct", T.BooleanType()),
    T.StructField("attempts", T.LongType()),
    T.StructField("correct", T.LongType()),
    T.StructField("streak", T.LongType()),
    T.StructField("add", T.DoubleType()),
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
]


def partial_schema(answers: DataFrame, key: list[str] = KEY) -> T.StructType:
    time_type = answers.schema["answered_at"].dataType
    keys = [T.StructField(k, answers.schema[k].dataType) for k in key]
    times = [T.StructField("first_at", time_type), T.StructField("last_at", time_type)]
    return T.StructType(keys + times + _SUMMARY_FIELDS)


def single_answers(rows: pd.DataFrame, key: list[str] = KEY) -> pd.DataFrame:
    """Each answer as a partial of length one."""
    right = rows["is_correct"].to_numpy(dtype=bool)
    n = len(rows)
    return pd.DataFrame(
        {
            **{k: rows[k].astype(object) for k in key},
            "first_at": rows["answered_at"],
            "last_at": rows["answered_at"],
            "first_id": rows["id"],
            "first_correct": right,
            "attempts": np.ones(n, dtype=np.int64),
            "correct": right.astype(np.int64),
            "streak": right.astype(np.int64),
            "add": np.where(right, S.CORRECT_STEP, S.WRONG_STEP),
            "lo": np.full(n, S.PRIORITY_MIN),
            "hi": np.full(n, S.PRIORITY_MAX),
        }
    )


def compose_runs(parts: pd.DataFrame, key: list[str] = KEY) -> pd.DataFrame:
    """Compose neighbouring partials of the same key, pairwise until one is left."""
    same = np.ones(max(len(parts) - 1, 0), dtype=bool)
    for name in key:
        # Codes compare as numbers, whatever the type of the key; a missing key is one value.
        column = pd.factorize(parts[name], use_na_sentinel=False)[0]
        same &= column[1:] == column[:-1]
    firsts = np.flatnonzero(np.r_[True, ~same])
    run = np.cumsum(np.r_[True, ~same])
    p = {c: parts[c].to_numpy() for c in ("last_at", "attempts", "correct", "streak", "add", "lo", "hi")}
    while len(run) > len(firsts):
        same = run[1:] == run[:-1]
        starts = np.flatnonzero(np.r_[True, ~same])
        place = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))
        kept = np.flatnonzero(place % 2 == 0)
        paired = np.r_[same, False][kept]
        left = {c: v[kept[paired]] for c, v in p.items()}
        right = {c: v[kept[paired] + 1] for c, v in p.items()}
        all_right = right["streak"] == right["attempts"]
        merged = {
            "last_at": right["last_at"],
            "attempts": left["attempts"] + right["attempts"],
            "correct": left["correct"] + right["correct"],
            "streak": right["streak"] + np.where(all_right, left["streak"], 0),
            "add": left["add"] + right["add"],
            "lo": np.clip(left["lo"] + right["add"], right["lo"], right["hi"]),
            "hi": np.clip(left["hi"] + right["add"], right["lo"], right["hi"]),
        }
        p = {c: v[kept] for c, v in p.items()}
        for c, values in merged.items():
            p[c][paired] = values
        run = run[kept]
    return parts.iloc[firsts].reset_index(drop=True).assign(**p)


def _fold_sorted(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Fold a sorted partition; the last key of a batch is carried to the next."""
    carry = None
    for rows in batches:
        if rows.empty:
            continue
        parts = single_answers(rows, key)
        if carry is not None:
            parts = pd.concat([carry, parts], ignore_index=True)
        parts = compose_runs(parts, key)
        carry = parts.iloc[-1:]
        yield parts.iloc[:-1]
    if carry is not None:
        yield carry


def answer_partials(answers: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One partial row per key and contiguous piece of its history.

    ``key`` may go on after the learner and the question, say with a day.
    """
    columns = key + ORDER
    return (
        answers.select(*columns, "is_correct")
        .repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .mapInPandas(partial(_fold_sorted, key=key), partial_schema(answers, key))
    )


def merge_partials(partials: DataFrame, order: tuple[str, ...] = FIRST, key: list[str] = KEY) -> DataFrame:
    """Compose all partials of a key in the given order: one row per key.

    A key has one partial per range partition (or stored day) it touches, so
    the list below is bounded by the number of pieces, not by the answers.
    """
    fields = [*order, *[c for c in partials.columns if c not in (*key, *order)]]

    def compose(left, right):
        shift = right["add"]
        limit = lambda v: F.least(right["hi"], F.greatest(right["lo"], v))
        all_right = right["streak"] == right["attempts"]
        composed = {
            "last_at": right["last_at"],
            "attempts": left["attempts"] + right["attempts"],
            "correct": left["correct"] + right["correct"],
            "streak": right["streak"] + F.when(all_right, left["streak"]).otherwise(F.lit(0)),
            "add": left["add"] + shift,
            "lo": limit(left["lo"] + shift),
            "hi": limit(left["hi"] + shift),
        }
        # What describes the first answer stays as it is on the left.
        return F.struct(*[composed.get(c, left[c]).alias(c) for c in fields])

    pieces = partials.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces")
    )
    first = F.col("pieces")[0]
    later = F.slice("pieces", F.lit(2), F.greatest(F.size("pieces") - 1, F.lit(0)))
    folded = F.when(F.size("pieces") == 1, first).otherwise(F.reduce(later, first, compose))
    return pieces.select(*key, folded.alias("f")).select(*key, *[f"f.{c}" for c in fields])


def performance_from_partials(
    partials: DataFrame, questions: DataFrame, order: tuple[str, ...] = FIRST
) -> DataFrame:
    """Partials as the performance table; answers to unknown questions drop out.

    The topic is the bank's, or that of the first answer where partials keep it.
    """
    kept = F.col("topic") if "topic" in partials.columns else F.lit(None).cast("string")
    state = merge_partials(partials, order).select(
        *KEY,
        kept.alias("_topic"),
        F.col("attempts").alias("total_attempts"),
        F.col("correct").alias("correct_attempts"),
        (F.col("attempts") - F.col("correct")).alias("incorrect_attempts"),
        F.col("last_at").alias("last_answered_at"),
        "streak",
        priority().alias("priority_score"),
    )
    topics = questions.select("question_id", "topic")
    return state.join(topics, "question_id").select(
        *KEY,
        F.coalesce("_topic", "topic").alias("topic"),
        "total_attempts",
        "correct_attempts",
        "incorrect_attempts",
        "last_answered_at",
        "streak",
        "priority_score",
    )


def priority() -> Column:
    """The priority score that a partial from a key's first answer on amounts to."""
    # The first answer scores -1 or 5; starting the fold at 1 or 0 gives just that.
    start = F.when(
        F.col("first_correct"), S.FIRST_CORRECT_PRIORITY - S.CORRECT_STEP
    ).otherwise(S.FIRST_WRONG_PRIORITY - S.WRONG_STEP)
    return F.least(F.col("hi"), F.greatest(F.col("lo"), start + F.col("add")))


def refresh_partials(known: DataFrame, new_answers: DataFrame) -> DataFrame:
    """Stored partials with later answers folded in; the old log is not read again."""
    return merge_partials(known.unionByName(answer_partials(new_answers)))


def performance(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """The learner-state table computed from the whole answer log."""
    return performance_from_partials(answer_partials(answers), questions)


#: Rows of a slice of the sorted answers, about.
SLICE_ROWS = 1_000_000

_MAP = ["attempts", "correct", "streak", "add", "lo", "hi"]


def _composed(left: dict, right: dict) -> dict:
    """First the left piece of a history, then the right one; arrays of equal length."""
    all_right = right["streak"] == right["attempts"]
    return {
        "attempts": left["attempts"] + right["attempts"],
        "correct": left["correct"] + right["correct"],
        "streak": right["streak"] + np.where(all_right, left["streak"], 0),
        "add": left["add"] + right["add"],
        "lo": np.clip(left["lo"] + right["add"], right["lo"], right["hi"]),
        "hi": np.clip(left["hi"] + right["add"], right["lo"], right["hi"]),
    }


def scanned(parts: dict, new_run: np.ndarray) -> dict:
    """For each piece its run up to and with it, by doubling steps; new_run marks where a run begins."""
    first = np.maximum.accumulate(np.where(new_run, np.arange(len(new_run)), 0))
    place = np.arange(len(new_run)) - first
    out, step, longest = {c: np.array(v) for c, v in parts.items()}, 1, int(place.max(initial=0))
    while step <= longest:
        at = np.flatnonzero(place >= step)
        merged = _composed({c: v[at - step] for c, v in out.items()}, {c: v[at] for c, v in out.items()})
        for c, values in merged.items():
            out[c][at] = values
        step *= 2
    return out


def _scan_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each answer with the composed steps of its key in the slice, and whether the first of these was right.

    The last row of a batch is carried to the next.
    """
    carry = None
    for rows in batches:
        if rows.empty:
            continue
        parts = single_answers(rows)
        parts = parts[[*KEY, *_MAP]].assign(began=parts["first_correct"])
        held = pd.concat([carry, parts], ignore_index=True) if carry is not None else parts
        new = np.zeros(len(held), dtype=bool)
        new[0] = True
        for name in KEY:
            column = pd.factorize(held[name], use_na_sentinel=False)[0]
            new[1:] |= column[1:] != column[:-1]
        scan = scanned({c: held[c].to_numpy() for c in _MAP}, new)
        scan["began"] = held["began"].to_numpy(dtype=bool)[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        own = {c: v[len(held) - len(rows) :] for c, v in scan.items()}
        carry = held.iloc[-1:].assign(**{c: v[-1:] for c, v in own.items()})
        yield rows.assign(**own)


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    """What the earlier slices of a key hand to each of its slices; one row per slice it touches."""
    pieces = pieces.sort_values("chunk", ignore_index=True)
    scan = scanned({c: pieces[c].to_numpy() for c in _MAP}, np.arange(len(pieces)) == 0)
    began = np.full(len(pieces) - 1, pieces["began"].iloc[0])
    return pieces[[*KEY, "chunk"]].iloc[1:].assign(**{f"in_{c}": v[:-1] for c, v in scan.items()}, in_began=began)


def running_state(answers: DataFrame) -> DataFrame:
    """Per answer: attempt number, correct so far, streak and priority score as of that answer.

    A prefix scan of clamped steps in three passes, none of which holds the
    history of a key. The answers are range-partitioned by (user, question,
    time, id) into slices of about SLICE_ROWS, so a busy key, even within a
    day, is cut over many tasks, and each slice is scanned from its own start.
    Only a key at a slice's border lies in more than one: for these (at most
    one for each border) the slices' last rows are composed, and what enters a
    slice is handed back to its rows. The scanned slices are stored, so that
    all passes see the same borders.
    """
    columns = [*KEY, *ORDER]
    slices = max(1, -(-answers.count() // SLICE_ROWS))
    rows = answers.select("id", *KEY, "answered_at", F.coalesce("is_correct", F.lit(False)).alias("is_correct"))
    rows = rows.repartitionByRange(max(slices, answers.sparkSession.sparkContext.defaultParallelism), *columns)
    types = {"attempts": T.LongType(), "correct": T.LongType(), "streak": T.LongType()}
    scanned_type = T.StructType([*rows.schema.fields, *[T.StructField(c, types.get(c, T.DoubleType())) for c in _MAP], T.StructField("began", T.BooleanType())])
    local = rows.sortWithinPartitions(*columns).mapInPandas(_scan_sorted, scanned_type)
    local = stored(local.withColumn("chunk", F.spark_partition_id()), "slices")

    cut = local.groupBy(*KEY).agg(F.min("chunk").alias("from"), F.max("chunk").alias("to")).where(F.col("from") < F.col("to"))
    cut = stored(cut.select(*[F.col(k).alias(f"cut_{k}") for k in KEY]), "cut-keys")
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"c.cut_{k}"))
    of_cut = local.alias("l").join(cut.alias("c"), same, "left_semi")
    last = F.max_by(F.struct(*_MAP), "attempts").alias("last")
    pieces = of_cut.groupBy(*KEY, "chunk").agg(last, F.first("began").alias("began"))
    pieces = pieces.select(*KEY, "chunk", "began", "last.*")
    keys = [T.StructField(k, answers.schema[k].dataType) for k in KEY]
    handed = [T.StructField(f"in_{c}", types.get(c, T.DoubleType())) for c in _MAP]
    entry_type = T.StructType([*keys, T.StructField("chunk", T.IntegerType()), *handed, T.StructField("in_began", T.BooleanType())])
    entries = stored(pieces.groupBy(*KEY).applyInPandas(_entries, entry_type), "entries")

    same = F.col("l.chunk") == F.col("e.chunk")
    for k in KEY:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"e.{k}"))
    joined = local.alias("l").join(entries.alias("e"), same, "left")
    of = lambda c: F.coalesce(F.col(f"e.in_{c}"), F.lit(0))
    unbroken = F.col("l.streak") == F.col("l.attempts")
    # Without an entry the key begins in this slice.
    began = F.coalesce("e.in_began", "l.began")
    start = F.when(began, S.FIRST_CORRECT_PRIORITY - S.CORRECT_STEP).otherwise(S.FIRST_WRONG_PRIORITY - S.WRONG_STEP)
    entering = F.when(F.col("e.chunk").isNull(), start).otherwise(
        F.least(F.col("e.in_hi"), F.greatest(F.col("e.in_lo"), start + F.col("e.in_add")))
    )
    return joined.select(
        "l.id",
        *[F.col(f"l.{k}") for k in KEY],
        "l.answered_at",
        "l.is_correct",
        (of("attempts") + F.col("l.attempts")).alias("attempt_no"),
        (of("correct") + F.col("l.correct")).alias("correct_so_far"),
        (F.col("l.streak") + F.when(unbroken, of("streak")).otherwise(F.lit(0))).alias("streak"),
        F.least(F.col("l.hi"), F.greatest(F.col("l.lo"), entering + F.col("l.add"))).alias("priority_score"),
    )


def answer_progress(answers: DataFrame) -> DataFrame:
    """Per answer: attempt number, correct so far and current streak."""
    return running_state(answers).drop("priority_score")
