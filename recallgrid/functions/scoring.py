"""Score expressions: ratios, mastery levels and selection weights."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid import schemas as S


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, 0.0 when there is nothing to divide by."""
    whole = whole.cast("double")
    return F.when(whole > 0, part.cast("double") / whole * 100.0).otherwise(F.lit(0.0))


def count_true(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def _mastery(accuracy: Column, answered: Column, pick, otherwise) -> Column:
    chain = None
    for rule in S.MASTERY_RULES:
        _, min_accuracy, min_answered, _ = rule
        met = answered >= min_answered
        if min_accuracy is not None:
            met = met & (accuracy >= min_accuracy)
        value = F.lit(pick(rule))
        chain = F.when(met, value) if chain is None else chain.when(met, value)
    return chain.otherwise(F.lit(otherwise))


def mastery_level(accuracy: Column, answered: Column) -> Column:
    return _mastery(accuracy, answered, lambda rule: rule[0], 0)


def mastery_status(accuracy: Column, answered: Column) -> Column:
    named = _mastery(accuracy, answered, lambda rule: rule[3], S.LEVEL_ZERO_STATUS)
    return F.when(answered == 0, F.lit(S.NOT_STARTED_STATUS)).otherwise(named)


def stars(level: Column) -> Column:
    return F.concat(
        F.repeat(F.lit(S.FILLED_STAR), level), F.repeat(F.lit(S.EMPTY_STAR), 5 - level)
    )


def weight_v1(priority: Column) -> Column:
    """Session weight of an answered question."""
    return F.when(priority > 0, F.greatest(priority, F.lit(0.1))).otherwise(F.lit(0.5))


def weight_v2(priority: Column) -> Column:
    """Within-topic weight of an answered question; rises again below zero."""
    low = F.abs(F.greatest(priority, F.lit(S.PRIORITY_MIN))) * 0.1 + 0.5
    return F.when(priority > 0, priority).otherwise(low)


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")
    )
