"""Every operator as a query over the driver tables."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators import (
    classify,
    dedup,
    enrich,
    exams,
    html_items,
    images,
    lookups,
    maintenance,
    mastery,
    quality,
    recommend,
    sampling,
    stats,
)
from recallgrid.operators.performance import answer_progress, performance, running_state
from recallgrid.plans import build_bank, derived
from recallgrid.plans import fixtures as X
from recallgrid.sources.storage import new_path, stored
from recallgrid.streaming import answers as stream
from recallgrid.streaming import impressions

SEED = "recallgrid"
EXAM_SIZE = 12

QUERIES = {}


def query(function):
    """Register a query under its function name."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


def _dense(spark, sf):
    """Questions, answers with long histories and the learner state from them."""
    q = X.questions(spark, sf)
    a = X.dense(X.answers(spark, sf))
    return q, a, performance(a, q)


def _sparse(spark, sf):
    q, a = X.questions(spark, sf), X.answers(spark, sf)
    return q, a, performance(a, q)


def _stored(triple):
    """For queries that use the learner state more than once."""
    q, a, perf = triple
    return q, a, stored(perf, "performance")


# --- Learner state -----------------------------------------------------------


@query
def learner_state(spark, sf):
    return _dense(spark, sf)[2]


@query
def answer_history(spark, sf):
    return answer_progress(X.dense(X.answers(spark, sf))).drop("answered_at")


@query
def answer_states(spark, sf):
    """What the state of a key was after each answer, over the whole bank."""
    return running_state(X.answers(spark, sf)).drop("answered_at", "is_correct")


@query
def answer_states_dense(spark, sf):
    """The same on ten questions, whose histories are long."""
    return running_state(X.dense(X.answers(spark, sf))).select("id", "attempt_no", "streak", "priority_score")


def _arriving(spark, sf, name, slices):
    """A table as a stream of micro-batches in order of time."""
    folder = derived.time_slices(spark, sf, name, slices)
    return spark.readStream.schema(X.table(spark, sf, name).schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def learner_state_stream(spark, sf):
    """The answer log read as a stream of 14 micro-batches; state equals the batch fold."""
    log = X.dense(X.answers_from_events(_arriving(spark, sf, "events", 14)))
    table = new_path(spark, "learner-state")
    started = stream.keep_state(log, table, new_path(spark, "learner-state-checkpoint"), most_parts=4)
    started.awaitTermination()
    return stream.current_performance(spark, table, X.questions(spark, sf))


@query
def learner_state_store(spark, sf):
    """The same with the state in Spark's state store; the last row of each key counts."""
    log = X.answers_from_events(_arriving(spark, sf, "events", 3))
    table = new_path(spark, "changed-states")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/{number}")

    changed = stream.stateful_performance(log, X.questions(spark, sf)).writeStream.outputMode("update")
    started = changed.foreachBatch(keep).option("checkpointLocation", new_path(spark, "state-store")).trigger(availableNow=True)
    started.start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(table)
    newest = rows.groupBy("username", "question_id").agg(F.max_by(F.struct(*rows.columns), "batch").alias("row"))
    return newest.select("row.*").drop("batch")


@query
def urgent_questions(spark, sf):
    return mastery.priority_list(_dense(spark, sf)[2], 3).select(
        "username", "rank", "question_id", "priority_score"
    )


@query
def weak_questions(spark, sf):
    q, _, perf = _dense(spark, sf)
    weak = perf.where(recommend.is_weak()).select("question_id").distinct()
    return q.join(weak, "question_id", "left_semi").select("question_id", "topic")


@query
def mastered_questions(spark, sf):
    perf = _dense(spark, sf)[2]
    return perf.where(recommend.is_mastered()).select("username", "question_id", "streak")


@query
def never_answered_questions(spark, sf):
    q, a = X.questions(spark, sf), X.answers(spark, sf)
    return maintenance.missing_from(q, a.select("question_id").distinct()).select(
        "question_id", "topic"
    )


@query
def questions_with_performance(spark, sf):
    q, _, perf = _dense(spark, sf)
    return q.join(perf.drop("topic"), "question_id", "left").select(
        "question_id", "topic", "username", "total_attempts", "priority_score"
    )


# --- Statistics --------------------------------------------------------------


@query
def learner_totals(spark, sf):
    return rounded(stats.user_totals(X.answers(spark, sf)), "accuracy")


@query
def accuracy_by_topic(spark, sf):
    return rounded(stats.topic_stats(X.answers(spark, sf), X.questions(spark, sf)), "accuracy")


@query
def topic_performance(spark, sf):
    return rounded(stats.topic_performance(_sparse(spark, sf)[2]), "avg_priority", "accuracy")


@query
def topic_mastery_by_question(spark, sf):
    return rounded(
        mastery.topic_mastery_levels(_sparse(spark, sf)[2]), "accuracy", "avg_priority"
    )


@query
def topic_mastery_by_attempt(spark, sf):
    q, a, perf = _sparse(spark, sf)
    graded = mastery.all_topic_masteries(perf, q, stats.learners(a))
    return rounded(graded, "accuracy", "progress")


@query
def weakest_topic(spark, sf):
    return mastery.weakest_topic(mastery.topic_mastery_levels(_sparse(spark, sf)[2]))


@query
def hardest_questions(spark, sf):
    return stats.hardest_questions(X.answers(spark, sf), X.questions(spark, sf))


@query
def review_totals(spark, sf):
    return stats.review_totals(X.reviews(spark, sf))


@query
def answered_questions(spark, sf):
    return stats.answered_questions(X.answers(spark, sf))


@query
def bank_counts(spark, sf):
    return stats.bank_counts(derived.image_bank(spark, sf))


@query
def topic_distribution(spark, sf):
    return rounded(stats.distribution(X.questions(spark, sf), "topic"), "pct")


@query
def extraction_profile(spark, sf):
    return stats.extraction_profile(derived.image_bank(spark, sf))


@query
def extraction_profile_with_issues(spark, sf):
    """The same summary with the findings of the questions counted by kind."""
    bank = derived.image_bank(spark, sf)
    codes = F.array(F.when(F.size("images") == 0, "no_image"), F.when(F.size("images") > 5, "many_images"))
    return stats.extraction_profile(bank, bank.select(F.explode(F.array_compact(codes)).alias("code")))


# --- Parts of the bank and the log --------------------------------------------


@query
def questions_of_topics(spark, sf):
    found = lookups.of_topics(X.questions(spark, sf), "PROMO", "SMALL")
    return found.select("question_id", "question_number", "topic")


@query
def answered_bank(spark, sf):
    """Questions looked up by the ids in the answer log."""
    return lookups.by_ids(X.questions(spark, sf), X.answers(spark, sf)).select("question_id", "topic")


@query
def questions_with_images(spark, sf):
    return lookups.with_images(derived.image_bank(spark, sf)).select(
        "question_id", F.size("images").alias("n_images")
    )


@query
def learners(spark, sf):
    return stats.learners(X.answers(spark, sf))


@query
def repeated_topics(spark, sf):
    return recommend.repeated_topic(X.impressions(spark, sf), X.questions(spark, sf))


@query
def next_topic(spark, sf):
    """The weakest topic, untouched topics included."""
    q, a, perf = _sparse(spark, sf)
    return mastery.weakest_topic(mastery.listed_topics(perf, q, stats.learners(a)))


# --- Exams -------------------------------------------------------------------


@query
def exam_names(spark, sf):
    return stats.exam_names(X.questions(spark, sf))


@query
def exam_order(spark, sf):
    return exams.exam_questions(X.questions(spark, sf)).select(
        "reconstruction_name", "reconstruction_order", "question_id"
    )


@query
def exam_progress(spark, sf):
    return rounded(
        exams.exam_progress(X.answers(spark, sf), X.questions(spark, sf)), "accuracy", "progress"
    )


@query
def exam_progress_complete(spark, sf):
    return rounded(
        exams.exam_progress_all(X.answers(spark, sf), X.questions(spark, sf)),
        "accuracy",
        "progress",
    )


# --- De-duplication and enrichment -------------------------------------------


@query
def text_deduplicated(spark, sf):
    ranked = dedup.union_sources([X.bank(spark, sf), derived.benchmark_bank(spark, sf)])
    return dedup.drop_text_duplicates(ranked).select("source_rank", "ordinal", "source_file")


@query
def first_of_each_length(spark, sf):
    """Ids with many repeats: the text length stands in for an id."""
    return dedup.keep_first(derived.length_ids(spark, sf), "question_id", ["ordinal"]).select(
        "question_id", "ordinal", "source_file"
    )


@query
def repeated_ids(spark, sf):
    return dedup.duplicate_report(derived.length_ids(spark, sf))


def _merged(spark, sf):
    return enrich.merge_topics(X.bank(spark, sf), X.history(spark, sf), X.manual(spark, sf))


@query
def topic_merge(spark, sf):
    return _merged(spark, sf).select("question_id", "topic", "topic_source")


@query
def topic_merge_counters(spark, sf):
    return enrich.merge_counters(_merged(spark, sf))


@query
def unclassified_report(spark, sf):
    return enrich.unclassified_report(_merged(spark, sf))


@query
def topics_outside_list(spark, sf):
    return enrich.invalid_topics(X.bank(spark, sf), ["fr"]).select("question_id", "topic")


# --- Classifier answers ------------------------------------------------------


@query
def classified_responses(spark, sf):
    return rounded(classify.parse_responses(derived.responses(spark, sf)), "confidence")


@query
def category_summary(spark, sf):
    classified = classify.parse_responses(derived.responses(spark, sf))
    return rounded(stats.category_summary(classified), "avg_confidence", "pct")


@query
def confidence_histogram(spark, sf):
    classified = classify.parse_responses(derived.responses(spark, sf))
    return rounded(stats.confidence_histogram(classified), "pct")


@query
def categories_attached(spark, sf):
    labelled = X.history(spark, sf).select(
        "question_id", F.col("topic").alias("category"), F.lit(0.9).alias("confidence")
    )
    return classify.attach_categories(X.bank(spark, sf), labelled).select(
        "question_id", "topic", "topic_confidence"
    )


@query
def not_yet_classified(spark, sf):
    return classify.not_yet_classified(X.bank(spark, sf), X.history(spark, sf)).select(
        "question_id"
    )


@query
def classifier_prompts(spark, sf):
    bank = X.bank(spark, sf).select(
        "question_id",
        "question_text",
        F.col("source_file").alias("correct_answer"),
        F.col("source_type").alias("explanation"),
    )
    return classify.prompts(bank).select("question_id", F.md5("prompt").alias("prompt_md5"))


# --- Validation --------------------------------------------------------------


@query
def import_findings(spark, sf):
    checked = quality.check_for_import(derived.raw_questions(spark, sf))
    return quality.issue_rows(checked)


@query
def strict_findings(spark, sf):
    checked = quality.check_strictly(derived.raw_questions(spark, sf))
    return quality.issue_rows(checked)


@query
def finding_histogram(spark, sf):
    return quality.issue_histogram(quality.check_for_import(derived.raw_questions(spark, sf)))


@query
def import_report(spark, sf):
    checked = quality.check_for_import(derived.raw_questions(spark, sf))
    typed = checked.withColumn("q", F.from_json("json", derived.REPORT_FIELDS)).select(
        "issues", "q.images", "q.reconstruction_name"
    )
    return quality.import_report(typed)


# --- Images ------------------------------------------------------------------


def _image_rows(spark, sf):
    bank = derived.image_bank(spark, sf)
    return images.classify_images(bank, derived.image_map(spark, sf), derived.HOSTED)


@query
def images_rewritten(spark, sf):
    out = images.rewrite_images(
        derived.image_bank(spark, sf), derived.image_map(spark, sf), derived.HOSTED
    )
    return out.select("question_id", F.concat_ws(" ", "images").alias("images"))


@query
def image_counters(spark, sf):
    return images.rewrite_counters(_image_rows(spark, sf))


@query
def image_migration_status(spark, sf):
    return images.migration_status(_image_rows(spark, sf))


@query
def images_to_move(spark, sf):
    return images.pending_images(_image_rows(spark, sf))


@query
def page_links(spark, sf):
    links = html_items.attribute_values(X.table(spark, sf, "pages"), "a", "href", "page_id")
    return links.select("page_id", F.concat_ws(" ", "values").alias("links"))


@query
def page_file_names(spark, sf):
    url = F.col("url")
    name = text.url_file_name(url)
    return X.table(spark, sf, "pages").select(
        "page_id",
        name.alias("file_name"),
        text.storage_name(F.col("url"), F.lit(1), url).alias("storage_name"),
    )


# --- HTML extraction ---------------------------------------------------------


@query
def quiz_page_questions(spark, sf):
    raw = html_items.raw_items(derived.quiz_pages(spark, sf), "quiz")
    return derived.flat_question(html_items.quiz_questions(raw).where("parsed"))


def _exam_items(spark, sf):
    """Parsed once: numbering reads the items and their counts per file."""
    pages = derived.quiz_pages(spark, sf, marked=False)
    raw = stored(html_items.raw_items(pages, "quiz"), "raw-items")
    items = html_items.exam_quiz_questions(raw)
    return items.withColumn("reconstruction_name", F.col("folder"))


@query
def exam_page_questions(spark, sf):
    items = _exam_items(spark, sf)
    numbered = exams.number_exam(items)
    exam = html_items.as_exam(numbered, "exam_quiz", "exam")
    return derived.flat_question(exam, "reconstruction_name", "reconstruction_order")


@query
def exam_numbers_as_published(spark, sf):
    items = _exam_items(spark, sf)
    return exams.number_exam(items, keep_collisions=True).select(
        "reconstruction_name", "question_number", "reconstruction_order"
    )


@query
def accordion_page_questions(spark, sf):
    raw = html_items.raw_items(derived.accordion_pages(spark, sf), "accordion")
    cards = html_items.card_questions(raw, F.col("folder")).where("parsed")
    return derived.flat_question(cards)


@query
def plain_page_items(spark, sf):
    """Ordinary web pages hold no questions: per page the items found."""
    pages = X.table(spark, sf, "pages").select("page_id", "html")
    raw = html_items.raw_items(pages, "quiz")
    found = raw.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("page_id").join(found, "page_id", "left").select(
        "page_id", F.coalesce("n", F.lit(0)).alias("items")
    )


def _build_sources(spark, sf):
    """Exams first, then courses by module, then the quiz pages, as one bank."""

    def named(pages):
        return pages.withColumn("source_file", F.concat("stem", F.lit(".html")))

    return [
        build_bank.Source(named(derived.quiz_pages(spark, sf, marked=False)), "quiz", "exam", exam_prefix="exam_quiz"),
        build_bank.Source(named(derived.accordion_pages(spark, sf)), "accordion", "course", by_folder=True),
        build_bank.Source(named(derived.quiz_pages(spark, sf)), "quiz", "quiz"),
    ]


@query
def bank_from_pages(spark, sf):
    """The whole way from saved pages to a bank with topics."""
    no_history = spark.createDataFrame([], "question_id string, topic string, ordinal bigint")
    bank = build_bank.build_bank(_build_sources(spark, sf), no_history, valid_topics=None)
    return bank.select("question_id", "question_text", "topic", "topic_source", "source_type", "source_file")


@query
def bank_import(spark, sf):
    """The whole way from raw JSON into the stored bank: new content of the table."""
    table = derived.typed_bank(spark, sf)
    raw = derived.raw_questions(spark, sf).join(
        X.bank(spark, sf).select("question_id", "ordinal", "source_file"), "question_id"
    ).withColumn("question_id", F.col("question_id").cast("string"))
    content, _, _ = build_bank.import_bank(
        raw, table, derived.image_map(spark, sf), derived.at(derived.CHANGED_AT), update=True
    )
    return content.select(
        "question_id", "topic", F.size("answer_options").alias("n_options"), "source_type", "reconstruction_name"
    )


# --- Keyed tables ------------------------------------------------------------


@query
def bank_upsert(spark, sf):
    table = derived.stored_bank(spark, sf)
    changes = derived.changed_questions(spark, sf)
    return maintenance.upsert(table, changes, derived.at(derived.CHANGED_AT), order="ordinal").select(
        "question_id", "topic", "question_text", F.col("updated_at") == F.col("created_at")
    ).toDF("question_id", "topic", "question_text", "is_new_or_untouched")


@query
def cards_inserted(spark, sf):
    active = maintenance.active_cards(X.cards(spark, sf))
    incoming = X.cards(spark, sf)
    marked = maintenance.insert_new(active, incoming, ["username", "front_text"], ["id"])
    return marked.select("username", "id", "outcome")


@query
def card_outcomes(spark, sf):
    active = maintenance.active_cards(X.cards(spark, sf))
    marked = maintenance.insert_new(active, X.cards(spark, sf), ["username", "front_text"], ["id"])
    return maintenance.outcome_counts(marked)


@query
def active_cards(spark, sf):
    return maintenance.active_cards(X.cards(spark, sf)).select("username", "id", "front_text")


def _card_edits(cards):
    return cards.where("archived").select(
        "username",
        "id",
        F.substring("front_text", 1, 6).alias("front_text"),
        F.lit("seen").alias("back_text"),
        F.lit("t").alias("topic"),
    )


@query
def cards_updated(spark, sf):
    cards = X.cards(spark, sf)
    return maintenance.update_cards(cards, _card_edits(cards), ["username", "id"])


@query
def cards_archived(spark, sf):
    cards = X.cards(spark, sf)
    ids = cards.where(F.length("back_text") > 400).select("username", "id")
    return maintenance.archive_cards(cards, ids, ["username", "id"]).select(
        "username", "id", "archived"
    )


@query
def progress_reset(spark, sf):
    q, a, perf = _stored(_dense(spark, sf))
    # Learners with any mastered question start again.
    users = perf.where(recommend.is_mastered()).select("username")
    tables = {"answers": a, "performance": perf, "reviews": X.reviews(spark, sf), "cards": X.cards(spark, sf)}
    return maintenance.table_sizes(maintenance.reset_progress(tables, users))


@query
def cards_exported(spark, sf):
    """Export and import again: every active card comes back."""
    lines = maintenance.card_lines(X.cards(spark, sf))
    return maintenance.cards_from_lines(lines).drop("topic")


# --- Sampling and recommendation ---------------------------------------------


@query
def uniform_sample(spark, sf):
    return sampling.sample(X.questions(spark, sf), 50, SEED).select("question_id")


@query
def random_question_with_image(spark, sf):
    bank = derived.image_bank(spark, sf).where(F.size("images") > 0)
    return sampling.sample(bank, 1, SEED).select("question_id")


@query
def weighted_question(spark, sf):
    perf = _dense(spark, sf)[2]
    weight = recommend.weight_v2(F.col("priority_score"))
    return sampling.weighted_choice(perf, ["username"], weight, SEED)


@query
def recent_questions(spark, sf):
    return recommend.recent_questions(X.impressions(spark, sf))


def _recent_stream(spark, sf):
    """The last impressions, kept over seven micro-batches."""
    shown = X.impressions_from_events(_arriving(spark, sf, "events", 7))
    table = new_path(spark, "recent")
    impressions.keep_recent(shown, table, new_path(spark, "recent-checkpoint"), most_parts=2).awaitTermination()
    return impressions.recent_impressions(spark, table)


@query
def recent_questions_stream(spark, sf):
    return recommend.recent_questions(_recent_stream(spark, sf))


@query
def repeated_topics_stream(spark, sf):
    return recommend.repeated_topic(_recent_stream(spark, sf), X.questions(spark, sf))


@query
def session_weights(spark, sf):
    q, a, perf = _stored(_dense(spark, sf))
    return recommend.adaptive_weights(perf, q, stats.learners(a), 1)


@query
def topic_weights(spark, sf):
    q, a, perf = _stored(_dense(spark, sf))
    return rounded(recommend.adaptive_weights(perf, q, stats.learners(a), 2), "weight")


@query
def next_random(spark, sf):
    q, a = X.questions(spark, sf), X.answers(spark, sf)
    return recommend.random_pick(stats.learners(a), q, SEED)


@query
def next_unanswered(spark, sf):
    q, a = X.questions(spark, sf), X.answers(spark, sf)
    return recommend.unanswered_pick(stats.learners(a), stats.answered_questions(a), q, SEED)


@query
def next_weakest(spark, sf):
    q, a, perf = _stored(_dense(spark, sf))
    return recommend.weakest_pick(stats.learners(a), perf, q, SEED)


@query
def next_in_topic(spark, sf):
    q, a, perf = _stored(_sparse(spark, sf))
    pairs = perf.select("username", "topic").distinct()
    return recommend.pick_within_topic(pairs, perf, q, SEED)


@query
def next_topic_first(spark, sf):
    q, a, perf = _stored(_sparse(spark, sf))
    return recommend.topic_first_pick(stats.learners(a), perf, q, SEED)


def _largest_topic(questions):
    return questions.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").first()["topic"]


@query
def next_random_of_topic(spark, sf):
    """R5 with a topic: a random question of the largest topic."""
    q, a = X.questions(spark, sf), X.answers(spark, sf)
    return recommend.next_question(stats.learners(a), stats.answered_questions(a), q, SEED, "random", _largest_topic(q))


@query
def next_unanswered_of_topic(spark, sf):
    """R5 with a topic: an unanswered question of the largest topic, else any of it."""
    q, a = X.questions(spark, sf), X.answers(spark, sf)
    return recommend.next_question(stats.learners(a), stats.answered_questions(a), q, SEED, "unanswered", _largest_topic(q))


@query
def next_adaptive(spark, sf):
    q, a, perf = _stored(_dense(spark, sf))
    shown = X.dense(X.impressions(spark, sf))
    return recommend.adaptive_pick(stats.learners(a), perf, shown, q, SEED)


@query
def exam_paper_mixed(spark, sf):
    q, a = X.questions(spark, sf), X.answers(spark, sf)
    return recommend.exam_mixed(stats.learners(a), q, EXAM_SIZE, SEED)


@query
def exam_paper_challenging(spark, sf):
    q, a, perf = _stored(_sparse(spark, sf))
    return recommend.exam_challenging(stats.learners(a), perf, q, EXAM_SIZE, SEED)


@query
def exam_paper_balanced(spark, sf):
    q, a, perf = _stored(_dense(spark, sf))
    return recommend.exam_balanced(stats.learners(a), perf, q, EXAM_SIZE, SEED)
