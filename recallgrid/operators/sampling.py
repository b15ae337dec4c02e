"""Uniform and weighted samples, for all learners at once and reproducible.

Drawing one of N questions for each of M learners must not build N x M rows.
Questions a learner has never answered all weigh the same, so they are never
listed: a draw only needs how many there are and *which place among them* was
hit. ``draw`` races the answered questions (one key each) against the unlisted
ones (the order statistics of equal-rate exponentials) and afterwards turns the
places that won into question indexes. Work grows with answered questions and
picks, not with the size of the bank.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.functions.randomness import exponential, uniform
from recallgrid.sources.storage import stored

# Hash digits that split the bank into 4,096 buckets for numbering.
_BUCKET_DIGITS = 3
# Places per block when a place among the unlisted questions is resolved.
_BLOCK = 4096


def sample(frame: DataFrame, n: int, seed: str, key: str = "question_id") -> DataFrame:
    """n rows, uniform, without replacement: the smallest hash keys win."""
    return (
        frame.withColumn("_u", uniform(seed, key)).orderBy("_u", key).limit(n).drop("_u")
    )


def weighted_choice(
    items: DataFrame, keys: list[str], weight: Column, seed: str, item: str = "question_id"
) -> DataFrame:
    """One item per key, with probability proportional to its weight.

    Exponential race: the smallest ``-ln(u) / weight`` wins. Items without
    weight, null or not positive, win only where no item of the key has any; then all are equal.
    """
    weight = F.coalesce(weight, F.lit(0.0))
    positive = weight > 0
    race = exponential(seed, *keys, item) / F.when(positive, weight).otherwise(1.0)
    winner = F.min_by(item, F.struct((~positive).alias("last"), race.alias("race"), F.col(item)))
    return items.groupBy(*keys).agg(winner.alias(item))


def index_bank(questions: DataFrame) -> DataFrame:
    """Number the questions: ``idx`` within the topic and ``pos`` over all.

    Order is topic, then hash of the id. Numbers come from counts per hash
    bucket plus a row number inside each small bucket, so no task ever sees a
    whole topic.
    """
    hashed = questions.select(
        "question_id", "topic", F.md5(F.col("question_id").cast("string")).alias("_hash")
    ).withColumn("_bucket", F.substring("_hash", 1, _BUCKET_DIGITS))
    buckets = hashed.groupBy("topic", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = (
        Window.partitionBy("topic").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = buckets.select(
        "topic", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("topic", "_bucket").orderBy("_hash", "question_id")
    numbered = (
        hashed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["topic", "_bucket"])
        .withColumn("idx", F.col("_offset") + F.col("_rank"))
    )
    sizes = topic_sizes(questions).select("topic", "start")
    index = numbered.join(sizes, "topic").select(
        "question_id", "topic", "idx", (F.col("start") + F.col("idx")).alias("pos")
    )
    return stored(index, "bank-index")


def topic_sizes(questions: DataFrame) -> DataFrame:
    """Questions per topic and the first position of the topic."""
    counts = questions.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    # One row per topic, a few dozen in all: the only window without a key.
    earlier = Window.orderBy("topic").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def distinct_places(size: Column, picks: Column, seed: str, keys: list[str]) -> Column:
    """``picks`` different places out of ``size``, a uniform subset in random order.

    Floyd's subset sampling, one array per row; the hash order of the result
    makes the order uniform as well.
    """
    size, picks = size.cast("bigint"), F.least(picks.cast("bigint"), size.cast("bigint"))

    def add(chosen, j):
        place = F.floor(uniform(seed + "/place", *keys, j) * (j + 1)).cast("bigint")
        return F.array_append(chosen, F.when(F.array_contains(chosen, place), j).otherwise(place))

    empty = F.array().cast("array<bigint>")
    subset = F.reduce(F.sequence(size - picks, size - 1), empty, add)
    ordered = F.array_sort(
        F.transform(
            subset, lambda p: F.struct(uniform(seed + "/order", *keys, p).alias("u"), p.alias("p"))
        )
    )
    return F.when(picks > 0, F.transform(ordered, lambda s: s["p"])).otherwise(empty)


def uniform_picks(users: DataFrame, size: Column, picks: int, seed: str) -> DataFrame:
    """Per learner ``picks`` different positions of a bank of the given size."""
    places = distinct_places(F.col("size"), F.lit(picks), seed, ["username"])
    return (
        users.select("username", size.alias("size"))
        .select("username", F.posexplode(places).alias("rank", "pos"))
        .withColumn("rank", F.col("rank") + 1)
    )


def draw(
    targets: DataFrame, known: DataFrame, keys: list[str], max_picks: int, seed: str
) -> DataFrame:
    """Weighted draw without replacement from many pools at once.

    ``targets``: keys, size (questions in the pool), picks, free_weight (weight
    of every question not in ``known``). ``known``: keys, place (0-based index
    in the pool), weight; a null weight means the question may not be drawn.
    Returns keys, rank, place. ``targets`` is read twice, so it should be a
    stored table or cheap to compute.
    """
    known = stored(known, "known")
    listed = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_known"))
    pools = targets.join(listed, keys, "left").withColumn(
        "free", F.col("size") - F.coalesce("n_known", F.lit(0))
    )
    picks = F.least(F.col("picks").cast("bigint"), F.col("free"))

    def next_key(so_far, i):
        gap = exponential(seed + "/gap", *keys, i) / ((F.col("free") - i) * F.col("free_weight"))
        return F.array_append(so_far, F.element_at(so_far, -1) + gap)

    races = F.reduce(F.sequence(F.lit(0).cast("bigint"), picks - 1), F.array(F.lit(0.0)), next_key)
    free = (
        pools.where(picks > 0)
        .withColumn("_places", distinct_places(F.col("free"), picks, seed, keys))
        .withColumn("_races", F.slice(races, F.lit(2), F.size("_places")))
        .select(*keys, F.explode(F.arrays_zip("_places", "_races")).alias("z"))
        .select(
            *keys,
            F.lit(None).cast("bigint").alias("place"),
            F.col("z._places").alias("free_place"),
            F.col("z._races").alias("race"),
        )
    )
    race = exponential(seed + "/known", *keys, "place") / F.col("weight")
    own = known.where(F.col("weight").isNotNull()).select(
        *keys, "place", F.lit(None).cast("bigint").alias("free_place"), race.alias("race")
    )
    by_race = Window.partitionBy(*keys).orderBy("race", "place", "free_place")
    winners = (
        free.unionByName(own)
        .withColumn("rank", F.row_number().over(by_race))
        .where(F.col("rank") <= max_picks)
        .join(targets.select(*keys, "picks"), keys)
        .where(F.col("rank") <= F.col("picks"))
        .drop("picks", "race")
    )
    return _resolve_free_places(stored(winners, "winners"), known, keys)


def _resolve_free_places(winners: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Turn "the j-th question not listed" into its place in the pool.

    With the listed places sorted, j moves up by one for each listed place
    before it. The count is taken over blocks of places first and then inside
    one block, so no window is larger than a block.
    """
    block = (F.col("place") / _BLOCK).cast("bigint")
    listed = known.select(*keys, "place", block.alias("block"))
    per_block = listed.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_block.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    none = F.lit(None).cast("bigint")

    # Which block does each place fall into?
    steps = blocks.select(
        *keys,
        (F.col("block") * _BLOCK - F.col("before")).alias("at"),
        F.col("block"),
        F.col("before"),
        none.alias("rank"),
        none.alias("place"),
    )
    hits = winners.select(
        *keys,
        F.col("free_place").alias("at"),
        none.alias("block"),
        none.alias("before"),
        F.col("rank").cast("bigint").alias("rank"),
        "place",
    )
    # A step sorts before a hit at the same place, because it has no rank.
    along = Window.partitionBy(*keys).orderBy("at", F.asc_nulls_first("rank"), "block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    located = (
        hits.where(F.col("at").isNotNull())
        .unionByName(steps)
        .withColumn("block", F.last("block", ignorenulls=True).over(along))
        .withColumn("before", F.last("before", ignorenulls=True).over(along))
        .where(F.col("rank").isNotNull())
    )

    # How many listed places of that block lie before it?
    inside = Window.partitionBy(*keys, "block").orderBy("place")
    gaps = (
        listed.join(blocks.select(*keys, "block", "before"), [*keys, "block"])
        .withColumn("at", F.col("place") - F.col("before") - F.row_number().over(inside) + 1)
        .select(*keys, "block", "at", none.alias("rank"), none.alias("before"))
    )
    counted = Window.partitionBy(*keys, "block").orderBy(
        "at", F.asc_nulls_first("rank")
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    resolved = (
        located.select(*keys, "block", "at", "rank", "before")
        .unionByName(gaps)
        .withColumn("passed", F.sum(F.when(F.col("rank").isNull(), 1).otherwise(0)).over(counted))
        .where(F.col("rank").isNotNull())
        .select(
            *keys,
            "rank",
            (F.col("at") + F.coalesce("before", F.lit(0)) + F.col("passed")).alias("place"),
        )
    )
    return hits.where(F.col("at").isNull()).select(*keys, "rank", "place").unionByName(resolved)
