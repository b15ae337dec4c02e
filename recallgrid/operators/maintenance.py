"""Keyed table maintenance: upsert, insert-if-absent, update, purge.

Plain files have no MERGE, so each operator returns the new content of the
table (or the rows to append) and the caller writes it to a new path; see
``recallgrid.sources.writers.replace_table``. Joins are shaped so that a small
change set can be broadcast by Spark and the big table is only scanned.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.dedup import keep_first
from recallgrid.schemas import CARD_JSON
from recallgrid.sources.storage import stored


def upsert(
    table: DataFrame,
    changes: DataFrame,
    now: Column,
    key: str = "question_id",
    order: str | None = None,
) -> DataFrame:
    """Insert new keys; for known keys replace every column but created_at.

    ``order`` names a column of ``changes``: of a repeated key the last row wins.
    The changes are computed once, into the shared folder; the table is read
    for its rows and once more for its keys.
    """
    if order is not None:
        changes = keep_first(changes, key, [F.desc(order)]).drop(order)
    changes = stored(changes, "changes")
    stamps = ["created_at", "updated_at"]
    values = [c for c in table.columns if c not in [key, *stamps]]
    incoming = changes.select(key, F.struct(*values).alias("_new"))
    # The table is the streamed side of this join; nothing of it is kept.
    merged = table.join(incoming, key, "left").select(
        key,
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values],
        "created_at",
        F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    # Known keys among the changes: at most as many rows as there are changes.
    known = table.select(key).join(changes.select(key), key, "left_semi")
    fresh = (
        changes.join(known, key, "left_anti")
        .select(key, *values)
        .withColumns({"created_at": now, "updated_at": now})
    )
    return merged.unionByName(fresh)


def insert_new(
    table: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """The incoming rows marked ``inserted`` or ``skipped``.

    The first row of a key that the table does not have is inserted. Only key
    columns of the table are read; the incoming rows are computed once.
    """
    incoming = stored(incoming, "incoming")
    known = (
        table.select(*keys)
        .join(incoming.select(*keys), keys, "left_semi")
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    first = (
        incoming.groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("_first"))
    )
    outcome = F.when(
        F.col("_known").isNull() & (F.struct(*order) == F.col("_first")), "inserted"
    ).otherwise("skipped")
    return (
        incoming.join(first, keys)
        .join(known, keys, "left")
        .withColumn("outcome", outcome)
        .drop("_first", "_known")
    )


def rows_to_append(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("outcome") == "inserted").drop("outcome")


def outcome_counts(marked: DataFrame) -> DataFrame:
    return marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def missing_from(incoming: DataFrame, table: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows whose key the table does not have yet."""
    return incoming.join(table.select(key), key, "left_anti")


def update_cards(cards: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Replace front, back and topic of the cards named in ``changes``.

    A change that would give one learner the same front text twice is not
    applied: the pair (username, front_text) stays unique.
    """
    edits = changes.select(*key, *[F.col(c).alias(f"_{c}") for c in ("front_text", "back_text", "topic")])
    owners = cards.select("username", *[k for k in key if k != "username"], "front_text")
    wanted = edits.join(owners.withColumnRenamed("front_text", "_old"), key).withColumnRenamed(
        "_front_text", "front_text"
    )
    rank_key = [k for k in key if k != "username"]
    wanted = keep_first(wanted, F.struct("username", "front_text"), rank_key)
    # Another card already has that front: the change is rejected.
    taken = owners.select("username", "front_text", *[F.col(k).alias(f"_holder_{k}") for k in rank_key])
    clash = (
        wanted.join(taken, ["username", "front_text"])
        .where(F.struct(*rank_key) != F.struct(*[F.col(f"_holder_{k}") for k in rank_key]))
        .select(*key)
        .distinct()
    )
    applied = (
        wanted.join(clash, key, "left_anti")
        .withColumnRenamed("front_text", "_front_text")
        .select(*key, "_front_text", "_back_text", "_topic", F.lit(True).alias("_hit"))
    )
    out = cards.join(applied, key, "left")
    for c in ("front_text", "back_text", "topic"):
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*cards.columns)


def archive_cards(cards: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    hit = ids.select(*key).distinct().withColumn("_hit", F.lit(True))
    return (
        cards.join(hit, key, "left")
        .withColumn("archived", F.col("archived") | F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
        .select(*cards.columns)
    )


def active_cards(cards: DataFrame) -> DataFrame:
    return cards.where(~F.col("archived"))


def newest_cards(cards: DataFrame, user) -> DataFrame:
    """The active cards of one learner, the newest first."""
    mine = active_cards(cards).where(F.col("username") == F.lit(user))
    return mine.orderBy(F.desc("created_at"), F.desc("id"))


def reset_progress(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Answers, performance and reviews without the given learners; cards stay."""
    gone = users.select("username").distinct()
    kept = {"answers", "performance", "reviews"} & tables.keys()
    return {
        name: frame.join(gone, "username", "left_anti") if name in kept else frame
        for name, frame in tables.items()
    }


def clear_everything(tables: dict[str, DataFrame], keep: tuple[str, ...] = ("cards",)) -> dict[str, DataFrame]:
    """Empty frames with unchanged schemas for all tables but the kept ones."""
    return {n: f if n in keep else f.limit(0) for n, f in tables.items()}


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, for a before/after report."""
    counts = [
        f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        for name, f in tables.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def replay_answers(backup: DataFrame, next_id: int) -> DataFrame:
    """An old backup as answer rows that keep their time.

    The performance table is then rebuilt from the whole log, which the fold
    orders by time. Ids are unique from next_id on and follow the rows of the
    backup's files, so they only decide between answers of one instant.
    """
    return backup.select(
        (F.lit(next_id) + F.monotonically_increasing_id()).alias("id"),
        "username",
        "question_id",
        F.col("selected_answer").alias("user_answer"),
        F.col("is_correct").cast("boolean").alias("is_correct"),
        F.col("timestamp").cast("timestamp_ntz").alias("answered_at"),
        F.lit(None).cast("int").alias("response_time_seconds"),
    )


def card_lines(cards: DataFrame) -> DataFrame:
    """Active cards as JSON objects, one row per card: the form for bulk export.

    No learner's deck is gathered, so one very large deck is written by many tasks.
    """
    card = F.struct("front_text", "back_text", "topic")
    return active_cards(cards).select(
        "username", "id", F.to_json(card, {"ignoreNullFields": "false"}).alias("card_json")
    )


def cards_from_lines(lines: DataFrame) -> DataFrame:
    card = F.from_json("card_json", CARD_JSON.elementType)
    return lines.withColumn("c", card).select(
        "username", F.col("id").alias("ordinal"), "c.front_text", "c.back_text", "c.topic"
    )


def deck_as_json(cards: DataFrame, user) -> DataFrame:
    """The download of one learner: all active cards as one JSON array, newest first.

    Always one row, ``[]`` without cards.
    """
    card = F.struct("created_at", "id", "front_text", "back_text", "topic")
    ordered = F.reverse(F.array_sort(F.collect_list(card)))
    fields = F.transform(
        ordered,
        lambda c: F.struct(
            c["front_text"].alias("front_text"),
            c["back_text"].alias("back_text"),
            c["topic"].alias("topic"),
        ),
    )
    mine = active_cards(cards).where(F.col("username") == F.lit(user))
    return mine.agg(F.to_json(fields, {"ignoreNullFields": "false"}).alias("json")).select(
        F.lit(user).alias("username"), "json"
    )


def cards_from_json(documents: DataFrame) -> DataFrame:
    """(username, json) documents as card rows; ``ordinal`` is the place in the array."""
    parsed = documents.select("username", F.posexplode(F.from_json("json", CARD_JSON)).alias("ordinal", "c"))
    return parsed.select("username", "ordinal", "c.front_text", "c.back_text", "c.topic")
