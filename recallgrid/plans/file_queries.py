"""Queries for readers, writers and table upkeep: the driver tables go through files and come back."""

from pyspark.sql import functions as F

from recallgrid import schemas as S
from recallgrid.operators import lookups, maintenance
from recallgrid.operators.performance import performance
from recallgrid.plans import fixtures as X
from recallgrid.plans.catalog import QUERIES, _sparse, query
from recallgrid.plans.oracles import ORACLES, sql
from recallgrid.sources import readers, writers
from recallgrid.sources.storage import new_path
from recallgrid.streaming import answers as stream


@query
def bank_reread(spark, sf):
    """The stored bank, read in order."""
    path = new_path(spark, "bank")
    X.questions(spark, sf).write.parquet(path)
    return readers.read_bank(spark, path).select("question_id", "question_number", "topic")


ORACLES["bank_reread"] = """
    SELECT p_partkey AS question_id, CAST(p_partkey AS VARCHAR) AS question_number, p_type AS topic FROM part"""


@query
def question_files(spark, sf):
    """Written as JSON with all checks, then read as question files."""
    path = new_path(spark, "questions")
    fields = {f.name: F.lit(None).cast(f.dataType) for f in S.QUESTION_FILE.fields}
    rows = X.questions(spark, sf).withColumn("question_id", F.col("question_id").cast("string"))
    have = {c: F.col(c) for c in rows.columns}
    full = rows.select(*[(have.get(n, v)).cast(S.QUESTION_FILE[n].dataType).alias(n) for n, v in fields.items()])
    writers.write_questions(full.withColumn("ordinal", F.col("question_id").cast("long")), path)
    back = readers.read_questions_json(spark, path, lines=True)
    return back.select(
        "question_id", "topic", "question_text", "reconstruction_name", "reconstruction_order", F.size("images").alias("n_images")
    )


ORACLES["question_files"] = """
    SELECT CAST(p_partkey AS VARCHAR) AS question_id, p_type AS topic, p_name AS question_text,
           CASE WHEN p_size <= 25 THEN p_brand END AS reconstruction_name,
           CASE WHEN p_size <= 25 THEN p_partkey END AS reconstruction_order, 0 AS n_images FROM part"""


@query
def question_array_files(spark, sf):
    """Question files that are JSON arrays of up to 2,000 questions, read as questions and raw."""
    path = new_path(spark, "question-arrays")
    one = F.struct(F.col("question_id").cast("string").alias("question_id"), "topic", "question_text")
    rows = X.questions(spark, sf).groupBy(F.floor(F.col("question_id") / 2000).alias("file"))
    rows.agg(F.to_json(F.collect_list(one)).alias("value")).write.partitionBy("file").text(path)
    files = f"{path}/*/*.txt"
    back = readers.read_questions_json(spark, files).select("question_id", "topic", F.length("question_text").alias("n_chars"))
    raw = readers.read_raw_questions(spark, files).select("question_id", F.get_json_object("json", "$.question_text").alias("raw_text"))
    return back.join(raw, "question_id")


ORACLES["question_array_files"] = """
    SELECT CAST(p_partkey AS VARCHAR) AS question_id, p_type AS topic, length(p_name) AS n_chars, p_name AS raw_text FROM part"""


@query
def image_map_file(spark, sf):
    """S3: a stored place for each page's address, in JSON objects of up to 2,000 pages, read back."""
    path = new_path(spark, "image-map")
    pages = X.table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    entry = F.struct("url", F.concat(F.lit("stored/"), F.col("page_id").cast("string")).alias("to"))
    parts = pages.groupBy(F.floor(F.col("page_id") / 2000).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    parts.write.partitionBy("part").text(path)
    return readers.read_image_map(spark, f"{path}/*/*.txt")


ORACLES["image_map_file"] = """
    SELECT url AS original_url, 'stored/' || min(page_id) AS hosted_url FROM pages GROUP BY url"""


@query
def manual_topic_file(spark, sf):
    """Hand-made overrides through CSV."""
    path = new_path(spark, "manual")
    X.manual(spark, sf).select("question_id", "topic").write.csv(path, header=True)
    return readers.read_manual_topics(spark, path, ["m0", "m1"]).drop("ordinal")


ORACLES["manual_topic_file"] = """
    SELECT CAST(doc_id AS VARCHAR) AS question_id, 'm' || quality AS topic FROM labels WHERE toxic = 1"""


@query
def history_file(spark, sf):
    """Topics of an earlier run through JSON lines, one of them absent."""
    path = new_path(spark, "history")
    X.history(spark, sf).select(F.col("question_id").cast("string").alias("question_id"), "topic").write.json(path)
    absent = readers.read_history(spark, new_path(spark, "absent"), lines=True)
    return readers.read_history(spark, path, lines=True).unionByName(absent).drop("ordinal")


ORACLES["history_file"] = "SELECT CAST(doc_id AS VARCHAR) AS question_id, 'h' || quality AS topic FROM labels"


@query
def appended_answers(spark, sf):
    """The log written, and the purchases appended once more."""
    path, log = new_path(spark, "answers"), X.answers(spark, sf)
    log.write.parquet(path)
    writers.append(log.where(F.col("id") % 2 == 0), path)
    return spark.read.parquet(path).groupBy("username").agg(F.count(F.lit(1)).alias("n"))


ORACLES["appended_answers"] = """
    SELECT user_id AS username, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n
    FROM events GROUP BY user_id"""


def _dated_cards(spark, sf):
    return X.cards(spark, sf).withColumn("created_at", F.timestamp_seconds(F.col("id") % 5).cast("timestamp_ntz"))


def _first_learner(cards):
    """The smallest learner with an active card, the one whose deck is shown."""
    return maintenance.active_cards(cards).agg(F.min("username")).first()[0]


@query
def deck_of_learner(spark, sf):
    """The download of one learner as a JSON array, and the array read back."""
    cards = _dated_cards(spark, sf)
    deck = maintenance.deck_as_json(cards, _first_learner(cards))
    return maintenance.cards_from_json(deck).select("username", F.col("ordinal").cast("long").alias("place"), "front_text", "back_text")


_DECK = """
    SELECT username, row_number() OVER (ORDER BY id % 5 DESC, id DESC) - 1 AS place, {columns} FROM cards
    WHERE NOT archived AND username = (SELECT min(username) FROM cards WHERE NOT archived)"""
ORACLES["deck_of_learner"] = sql(["cards"], _DECK.format(columns="front_text, back_text"))


@query
def newest_cards_of_learner(spark, sf):
    """one learner's active cards in order; the place makes the order part of the result."""
    cards = _dated_cards(spark, sf)
    listed = maintenance.newest_cards(cards, _first_learner(cards)).agg(
        F.min("username").alias("username"), F.collect_list("id").alias("ids")
    )
    return listed.select("username", F.posexplode("ids").alias("place", "id")).withColumn("place", F.col("place").cast("long"))


ORACLES["newest_cards_of_learner"] = sql(["cards"], _DECK.format(columns="id"))


@query
def category_as_topic(spark, sf):
    """F8: the category replaces the topic."""
    classified = X.bank(spark, sf).select("question_id", "topic", F.col("source_type").alias("category"))
    return lookups.rename_category(classified)


ORACLES["category_as_topic"] = "SELECT doc_id AS question_id, lang AS topic FROM documents"


@query
def head_of_bank(spark, sf):
    """the head of a file is the feature, 50 rows of it."""
    return lookups.first_rows(X.bank(spark, sf), 50).select("question_id", "source_file")


ORACLES["head_of_bank"] = "SELECT doc_id AS question_id, source AS source_file FROM documents ORDER BY doc_id LIMIT 50"


@query
def everything_cleared(spark, sf):
    """K6: all tables but the cards are emptied; rows of each before and after."""
    tables = {"answers": X.answers(spark, sf), "reviews": X.reviews(spark, sf), "cards": X.cards(spark, sf)}
    after = maintenance.table_sizes(maintenance.clear_everything(tables)).withColumnRenamed("n", "n_after")
    return maintenance.table_sizes(tables).join(after, "table")


ORACLES["everything_cleared"] = sql(
    ["cards"],
    """SELECT 'answers' AS "table", count(*) AS n, 0::BIGINT AS n_after FROM events
       UNION ALL SELECT 'reviews', count(*), 0 FROM events
       UNION ALL SELECT 'cards', count(*), count(*) FROM cards""",
)


@query
def replayed_backup(spark, sf):
    """K8: an old backup replayed as answers, and the learner state rebuilt from them."""
    log = X.answers(spark, sf)
    backup = log.select(
        "username",
        "question_id",
        F.lit("a").alias("selected_answer"),
        F.col("is_correct").cast("int").alias("is_correct"),
        F.col("answered_at").alias("timestamp"),
    )
    rebuilt = performance(maintenance.replay_answers(backup, 1_000_000), X.questions(spark, sf))
    return rebuilt.select("username", "question_id", "total_attempts", "correct_attempts", "last_answered_at")


ORACLES["replayed_backup"] = sql(
    ["answers", "questions"],
    """SELECT username, question_id, count(*) AS total_attempts,
       CAST(count(*) FILTER (is_correct) AS BIGINT) AS correct_attempts, max(answered_at) AS last_answered_at
       FROM answers JOIN questions USING (question_id) GROUP BY username, question_id""",
)


@query
def learner_state_sparse(spark, sf):
    """A1 on the whole bank: every learner and question that meet, most of them a few times."""
    return _sparse(spark, sf)[2]


ORACLES["learner_state_sparse"] = sql(["perf"], "SELECT * FROM perf")


@query
def first_findings(spark, sf):
    """C4: what a failing import shows, its first 20 findings."""
    found = QUERIES["import_findings"](spark, sf)
    return found.orderBy(*[F.asc_nulls_last(c) for c in sorted(found.columns)]).limit(20)


ORACLES["first_findings"] = f"SELECT * FROM ({ORACLES['import_findings']}) ORDER BY code, path, question_id LIMIT 20"


@query
def topic_of_first_answer(spark, sf):
    """Two runs of the stream with a bank that changed in between; a key keeps its first topic."""
    log, bank = X.answers(spark, sf), X.questions(spark, sf)
    changed = bank.withColumn("topic", F.concat(F.lit("new "), "topic"))
    folder, table, progress = (new_path(spark, n) for n in ("log", "state", "progress"))
    for rows, questions in ((log.where("id % 2 = 0"), bank), (log.where("id % 2 = 1"), changed)):
        rows.write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(log.schema).parquet(folder)
        stream.keep_state(arriving, table, progress, questions=questions).awaitTermination()
    state = stream.current_performance(spark, table, changed)
    return state.select("username", "question_id", "topic", "total_attempts", "correct_attempts")


ORACLES["topic_of_first_answer"] = sql(
    ["answers", "questions"],
    """SELECT username, question_id, CASE WHEN min(id % 2) = 0 THEN topic ELSE 'new ' || topic END AS topic,
       count(*) AS total_attempts, CAST(count(*) FILTER (is_correct) AS BIGINT) AS correct_attempts
       FROM answers JOIN questions USING (question_id) GROUP BY username, question_id, topic""",
)
