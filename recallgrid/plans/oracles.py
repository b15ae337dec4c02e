"""The same queries as SQL over the same tables, to check results against."""

from recallgrid import schemas as S
from recallgrid.operators.classify import PROMPT
from recallgrid.plans.catalog import EXAM_SIZE, SEED

ORACLES = {}

# --- Views -------------------------------------------------------------------

_DENSE_ANSWERS = (
    "SELECT id, username, question_id % 10 AS question_id, is_correct, answered_at FROM answers"
)


def _perf(source: str) -> str:
    """The learner state of an answer relation, folded in order."""
    return f"""
    SELECT g.username, g.question_id, q.topic, total_attempts, correct_attempts,
           total_attempts - correct_attempts AS incorrect_attempts, last_answered_at,
           CAST(coalesce(nullif(list_position(list_reverse(h), false), 0) - 1, len(h)) AS BIGINT) AS streak,
           list_reduce(list_transform(h, lambda x, i:
               CASE WHEN i = 1 AND x THEN -1.0::DOUBLE WHEN i = 1 THEN 5.0::DOUBLE
                    WHEN x THEN -2.0::DOUBLE ELSE 5.0::DOUBLE END),
               lambda p, d: CASE WHEN d < 0 THEN greatest(p + d, -10.0::DOUBLE)
                                 ELSE least(p + d, 50.0::DOUBLE) END) AS priority_score
    FROM (SELECT username, question_id, count(*) AS total_attempts,
                 CAST(sum(is_correct::INT) AS BIGINT) AS correct_attempts,
                 max(answered_at) AS last_answered_at,
                 list(is_correct ORDER BY answered_at, id) AS h
          FROM {source} GROUP BY ALL) g
    JOIN questions q USING (question_id)"""


VIEWS = {
    "questions": """
    SELECT p_partkey AS question_id, CAST(p_partkey AS VARCHAR) AS question_number,
           p_type AS topic, p_name AS question_text,
           CASE WHEN p_size <= 25 THEN p_brand END AS reconstruction_name,
           CASE WHEN p_size <= 25 THEN p_partkey END AS reconstruction_order
    FROM part""",
    "answers": """
    SELECT event_id AS id, user_id AS username, CAST(props->>'$.k' AS BIGINT) AS question_id,
           event_type IN ('view', 'click', 'purchase') AS is_correct, ts AS answered_at
    FROM events""",
    "dense": _DENSE_ANSWERS,
    "perf": _perf("answers"),
    "dperf": _perf("dense"),
    "users": "SELECT DISTINCT username FROM answers",
    "shown": """
    SELECT event_id AS id, user_id AS username, CAST(props->>'$.k' AS BIGINT) AS question_id,
           ts AS shown_at
    FROM events WHERE event_type = 'view'""",
    "bank": """
    SELECT doc_id AS question_id, text AS question_text, source AS source_file, lang AS source_type,
           doc_id AS ordinal, CASE WHEN lang IN ('fr', 'de') THEN lang ELSE '' END AS topic
    FROM documents""",
    "cards": """
    SELECT u.conv_id AS username, u.turn AS id, u.text AS front_text, a.text AS back_text,
           CAST(NULL AS VARCHAR) AS topic, length(u.text) > 150 AS archived
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'""",
    "image_bank": r"""
    SELECT page_id AS question_id,
           regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']', 1) AS images,
           regexp_extract(url, '^https?://([^/]+)/', 1) AS source_file
    FROM pages""",
    "image_map": """
    SELECT DISTINCT unnest(images) AS url FROM image_bank WHERE len(images) > 5""",
    "image_rows": """
    SELECT i.question_id, i.pos, i.url,
           CASE WHEN i.url = '' THEN 'empty' WHEN contains(i.url, '/d') THEN 'already_hosted'
                WHEN m.url IS NOT NULL THEN 'replaced' ELSE 'not_found' END AS status
    FROM (SELECT question_id, unnest(images) AS url, generate_subscripts(images, 1) - 1 AS pos
          FROM image_bank) i
    LEFT JOIN image_map m ON i.url = m.url""",
    "idx": """
    SELECT question_id, topic,
           row_number() OVER (PARTITION BY topic ORDER BY md5(question_id::VARCHAR), question_id) - 1 AS idx,
           row_number() OVER (ORDER BY topic, md5(question_id::VARCHAR), question_id) - 1 AS pos
    FROM questions""",
    "sizes": """
    SELECT topic, count(*) AS n, min(pos) AS start FROM idx GROUP BY topic""",
    "merged": """
    SELECT b.question_id, b.question_text, b.source_type,
           CASE WHEN b.topic <> '' THEN b.topic WHEN m.doc_id IS NOT NULL THEN 'm' || m.quality
                WHEN h.doc_id IS NOT NULL THEN 'h' || h.quality ELSE 'Sin clasificar' END AS topic,
           CASE WHEN b.topic <> '' THEN 'already_had_topic'
                WHEN m.doc_id IS NOT NULL THEN 'matched_from_manual'
                WHEN h.doc_id IS NOT NULL THEN 'matched_from_historical'
                ELSE 'still_unclassified' END AS topic_source
    FROM bank b LEFT JOIN labels h ON h.doc_id = b.question_id
    LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) m ON m.doc_id = b.question_id""",
}
NEEDS = {
    "dense": ["answers"],
    "perf": ["answers", "questions"],
    "dperf": ["dense", "questions"],
    "users": ["answers"],
    "image_map": ["image_bank"],
    "image_rows": ["image_bank", "image_map"],
    "idx": ["questions"],
    "sizes": ["idx"],
    "merged": ["bank"],
}


def _level(accuracy: str, n: str) -> str:
    return f"""CASE WHEN {accuracy} >= 90 AND {n} >= 20 THEN 5 WHEN {accuracy} >= 80 AND {n} >= 15 THEN 4
        WHEN {accuracy} >= 70 AND {n} >= 10 THEN 3 WHEN {accuracy} >= 60 AND {n} >= 5 THEN 2
        WHEN {n} >= 3 THEN 1 ELSE 0 END"""


def _micro(perf: str) -> str:
    return f"""
    SELECT username, topic, count(*) AS questions_answered, sum(correct_attempts) AS total_correct,
           sum(total_attempts) AS total_attempts, avg(priority_score) AS avg_priority,
           sum(correct_attempts)::DOUBLE / sum(total_attempts) * 100 AS accuracy
    FROM {perf} GROUP BY ALL"""


def _masteries(perf: str) -> str:
    """Every learner with every topic of the bank."""
    return f"""
    SELECT u.username, t.topic, coalesce(m.accuracy, 0.0) AS accuracy,
           coalesce(m.questions_answered, 0) AS questions_answered,
           {_level('coalesce(m.accuracy, 0.0)', 'coalesce(m.questions_answered, 0)')} AS level
    FROM (SELECT DISTINCT username FROM {perf}) u
    CROSS JOIN (SELECT DISTINCT topic FROM questions) t
    LEFT JOIN ({_micro(perf)}) m ON m.username = u.username AND m.topic = t.topic"""


def sql(views: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """A statement with the views it needs in front."""
    ordered: list[str] = []

    def add(name):
        for n in NEEDS.get(name, []):
            add(n)
        if name not in ordered:
            ordered.append(name)

    for v in views:
        add(v)
    parts = [f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in ordered]
    parts += [f"{n} AS MATERIALIZED ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def uniform(seed: str, *parts: str) -> str:
    listed = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return (
        f"((('0x' || substr(md5(concat_ws('|', '{seed}', {listed})), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)"
        " / 4503599627370496.0::DOUBLE)"
    )


def floyd(size: str, picks: str, seed: str, *keys: str) -> str:
    place = f"CAST(floor({uniform(seed + '/place', *keys, 'e[1]')} * (e[1] + 1)) AS BIGINT)"
    return f"""list_reduce(list_transform(range({size} - {picks}, {size}), lambda j: [j]),
        lambda acc, e: CASE WHEN list_contains(acc, {place}) THEN list_append(acc, e[1])
                            ELSE list_append(acc, {place}) END, []::BIGINT[])"""


def draw(targets: str, known: str, keys: list[str], seed: str, name: str) -> dict[str, str]:
    """CTEs of a weighted draw; ``{name}`` holds keys, rank, place."""
    k = ", ".join(keys)
    t_keys = [f"t.{c}" for c in keys]
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    gap = f"-ln({uniform(seed + '/gap', *keys, 'i')}) / ((free - i) * free_weight)"
    return {
        f"{name}_t": f"""
        SELECT t.*, t.size - coalesce(n_known, 0) AS free FROM {targets} t
        LEFT JOIN (SELECT {k}, count(*) AS n_known FROM {known} GROUP BY ALL) USING ({k})""",
        f"{name}_u": f"""
        SELECT {k}, free, free_weight, unnest({floyd('free', 'least(picks, free)', seed, *keys)}) AS free_place
        FROM {name}_t WHERE least(picks, free) > 0""",
        f"{name}_o": f"""
        SELECT *, row_number() OVER (PARTITION BY {k}
            ORDER BY {uniform(seed + '/order', *keys, 'free_place')}, free_place) - 1 AS i FROM {name}_u""",
        f"{name}_f": f"""
        SELECT {k}, NULL::BIGINT AS place, free_place,
               sum({gap}) OVER (PARTITION BY {k} ORDER BY i ROWS UNBOUNDED PRECEDING) AS race FROM {name}_o""",
        f"{name}_w": f"""
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY race, place, free_place) AS rank FROM (
                SELECT * FROM {name}_f UNION ALL
                SELECT {k}, place, NULL, -ln({uniform(seed + '/known', *keys, 'place')}) / weight
                FROM {known} WHERE weight IS NOT NULL))
        JOIN (SELECT {k}, picks FROM {targets}) USING ({k}) WHERE rank <= picks""",
        f"{name}_all": f"""
        SELECT {', '.join(t_keys)}, unnest(range(0, t.size)) AS place FROM {targets} t""",
        f"{name}_free": f"""
        SELECT a.*, row_number() OVER (PARTITION BY {', '.join('a.' + c for c in keys)} ORDER BY a.place) - 1 AS j
        FROM {name}_all a LEFT JOIN {known} b ON {on} AND a.place = b.place WHERE b.place IS NULL""",
        name: f"""
        SELECT {', '.join('a.' + c for c in keys)}, a.rank, coalesce(a.place, b.place) AS place
        FROM {name}_w a LEFT JOIN {name}_free b ON {on} AND a.free_place = b.j""",
    }


# --- Learner state -----------------------------------------------------------

ORACLES["learner_state"] = sql(["dperf"], "SELECT * FROM dperf")
ORACLES["learner_state_stream"] = ORACLES["learner_state"]
ORACLES["learner_state_store"] = sql(["perf"], "SELECT * FROM perf")


def _states(source: str) -> str:
    """What an answer relation's state is after each answer."""
    return f"""
    SELECT id, username, question_id, n AS attempt_no,
           CAST(len(list_filter(h, lambda x: x)) AS BIGINT) AS correct_so_far,
           CAST(coalesce(nullif(list_position(list_reverse(h), false), 0) - 1, len(h)) AS BIGINT) AS streak,
           list_reduce(list_transform(h, lambda x, i:
               CASE WHEN i = 1 AND x THEN -1.0::DOUBLE WHEN i = 1 THEN 5.0::DOUBLE
                    WHEN x THEN -2.0::DOUBLE ELSE 5.0::DOUBLE END),
               lambda p, d: CASE WHEN d < 0 THEN greatest(p + d, -10.0::DOUBLE)
                                 ELSE least(p + d, 50.0::DOUBLE) END) AS priority_score
    FROM (SELECT id, username, question_id, row_number() OVER w AS n, list(is_correct) OVER w AS h
          FROM {source}
          WINDOW w AS (PARTITION BY username, question_id ORDER BY answered_at, id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


ORACLES["answer_states"] = sql(["answers"], _states("answers"))
ORACLES["answer_states_dense"] = sql(
    ["dense"], f"SELECT id, attempt_no, streak, priority_score FROM ({_states('dense')})"
)
ORACLES["answer_history"] = sql(
    ["dense"],
    """SELECT id, username, question_id, is_correct,
       row_number() OVER w AS attempt_no,
       CAST(sum(is_correct::INT) OVER w AS BIGINT) AS correct_so_far,
       CAST(sum(is_correct::INT) OVER (PARTITION BY username, question_id, wrongs ORDER BY answered_at, id) AS BIGINT) AS streak
    FROM (SELECT *, sum((NOT is_correct)::INT) OVER (PARTITION BY username, question_id
             ORDER BY answered_at, id) AS wrongs FROM dense)
    WINDOW w AS (PARTITION BY username, question_id ORDER BY answered_at, id)""",
)
ORACLES["urgent_questions"] = sql(
    ["dperf"],
    """SELECT username, CAST(rank AS INT) AS rank, question_id, priority_score FROM (
       SELECT *, row_number() OVER (PARTITION BY username ORDER BY priority_score DESC, question_id) AS rank
       FROM dperf) WHERE rank <= 3""",
)
ORACLES["weak_questions"] = sql(
    ["dperf"],
    """SELECT question_id, topic FROM questions WHERE question_id IN
       (SELECT question_id FROM dperf WHERE incorrect_attempts > correct_attempts)""",
)
ORACLES["mastered_questions"] = sql(
    ["dperf"],
    "SELECT username, question_id, streak FROM dperf WHERE streak >= 2 AND priority_score < -5",
)
ORACLES["never_answered_questions"] = sql(
    ["questions", "answers"],
    """SELECT question_id, topic FROM questions
       WHERE question_id NOT IN (SELECT question_id FROM answers)""",
)
ORACLES["questions_with_performance"] = sql(
    ["dperf"],
    """SELECT q.question_id, q.topic, p.username, p.total_attempts, p.priority_score
       FROM questions q LEFT JOIN dperf p USING (question_id)""",
)

# --- Statistics --------------------------------------------------------------

ORACLES["learner_totals"] = sql(
    ["answers"],
    """SELECT username, count(*) AS total_answered,
       CAST(count(*) FILTER (is_correct) AS BIGINT) AS total_correct,
       round(count(*) FILTER (is_correct) * 100.0::DOUBLE / count(*), 6) AS accuracy
       FROM answers GROUP BY username""",
)
ORACLES["accuracy_by_topic"] = sql(
    ["answers", "questions"],
    """SELECT username, topic, count(*) AS total, CAST(count(*) FILTER (is_correct) AS BIGINT) AS correct,
       round(count(*) FILTER (is_correct) * 100.0::DOUBLE / count(*), 6) AS accuracy
       FROM answers JOIN questions USING (question_id) GROUP BY username, topic""",
)
ORACLES["topic_performance"] = sql(
    ["perf"],
    f"""SELECT username, topic, questions_answered, CAST(total_correct AS BIGINT) AS total_correct,
        CAST(total_attempts AS BIGINT) AS total_attempts, round(avg_priority, 6) AS avg_priority,
        round(accuracy, 6) AS accuracy FROM ({_micro('perf')})""",
)
ORACLES["topic_mastery_by_question"] = sql(
    ["perf"],
    f"""SELECT username, topic, questions_answered, round(accuracy, 6) AS accuracy,
        round(avg_priority, 6) AS avg_priority, {_level('accuracy', 'questions_answered')} AS level
        FROM (SELECT username, topic, count(*) AS questions_answered,
              round(avg(correct_attempts::DOUBLE / total_attempts * 100), 9) AS accuracy,
              avg(priority_score) AS avg_priority FROM perf GROUP BY ALL)""",
)
ORACLES["topic_mastery_by_attempt"] = sql(
    ["perf"],
    f"""SELECT username, topic, level, repeat('⭐', level) || repeat('☆', 5 - level) AS stars,
        round(accuracy, 6) AS accuracy, round(least(accuracy, 100.0), 6) AS progress, questions_answered,
        CASE WHEN questions_answered = 0 THEN 'Sin iniciar' ELSE
        ['Iniciando', 'Principiante', 'Intermedio', 'Avanzado', 'Experto', 'Maestro'][level + 1] END AS status
        FROM ({_masteries('perf')})""",
)
ORACLES["weakest_topic"] = sql(
    ["perf"],
    f"""SELECT username, topic FROM (
        SELECT *, row_number() OVER (PARTITION BY username
            ORDER BY {_level('accuracy', 'n')}, accuracy, topic) AS r
        FROM (SELECT username, topic, count(*) AS n,
              round(avg(correct_attempts::DOUBLE / total_attempts * 100), 9) AS accuracy
              FROM perf GROUP BY ALL)) WHERE r = 1""",
)
ORACLES["hardest_questions"] = sql(
    ["answers", "questions"],
    """SELECT question_id, count(*) AS attempts, CAST(count(*) FILTER (NOT is_correct) AS BIGINT) AS errors,
       question_number, topic,
       floor(count(*) FILTER (NOT is_correct) * 1000.0::DOUBLE / count(*) + 0.5) / 10 AS error_rate
       FROM answers JOIN questions USING (question_id) GROUP BY question_id, question_number, topic
       HAVING count(*) > 5 ORDER BY error_rate DESC, question_id LIMIT 20""",
)
ORACLES["review_totals"] = """
    SELECT user_id AS username, count(*) AS total_reviewed,
           CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS correct_count
    FROM events GROUP BY user_id"""
ORACLES["answered_questions"] = sql(
    ["answers"], "SELECT DISTINCT username, question_id FROM answers"
)
ORACLES["bank_counts"] = sql(
    ["image_bank"],
    """SELECT count(*) AS questions, CAST(count(*) FILTER (len(images) > 0) AS BIGINT) AS with_images
       FROM image_bank""",
)
ORACLES["topic_distribution"] = sql(
    ["questions"],
    """SELECT topic AS value, n, round(pct, 6) AS pct, repeat('#', CAST(floor(pct / 2) AS INT)) AS bar
       FROM (SELECT topic, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct
             FROM questions GROUP BY topic)""",
)
ORACLES["extraction_profile"] = sql(
    ["image_bank"],
    """SELECT 'questions' AS metric, NULL::VARCHAR AS key, count(*) AS value FROM image_bank
       UNION ALL SELECT 'with_images', NULL, count(*) FILTER (len(images) > 0) FROM image_bank
       UNION ALL SELECT 'image_urls', NULL, CAST(sum(len(images)) AS BIGINT) FROM image_bank
       UNION ALL SELECT 'in_exams', NULL, count(*) FILTER (len(images) > 5 AND source_file <> '') FROM image_bank
       UNION ALL SELECT 'by_source_file', source_file, count(*) FROM image_bank GROUP BY source_file
       UNION ALL SELECT 'by_exam', source_file, count(*) FROM image_bank
                 WHERE len(images) > 5 AND source_file <> '' GROUP BY source_file
       UNION ALL SELECT 'duplicate_ids', NULL, count(*) - count(DISTINCT question_id) FROM image_bank""",
)
ORACLES["extraction_profile_with_issues"] = sql(
    ["image_bank"],
    """SELECT 'questions' AS metric, NULL::VARCHAR AS key, count(*) AS value FROM image_bank
       UNION ALL SELECT 'with_images', NULL, count(*) FILTER (len(images) > 0) FROM image_bank
       UNION ALL SELECT 'image_urls', NULL, CAST(sum(len(images)) AS BIGINT) FROM image_bank
       UNION ALL SELECT 'in_exams', NULL, count(*) FILTER (len(images) > 5 AND source_file <> '') FROM image_bank
       UNION ALL SELECT 'by_source_file', source_file, count(*) FROM image_bank GROUP BY source_file
       UNION ALL SELECT 'by_exam', source_file, count(*) FROM image_bank
                 WHERE len(images) > 5 AND source_file <> '' GROUP BY source_file
       UNION ALL SELECT 'duplicate_ids', NULL, count(*) - count(DISTINCT question_id) FROM image_bank
       UNION ALL SELECT 'issues', code, count(*) FROM (
           SELECT CASE WHEN len(images) = 0 THEN 'no_image' WHEN len(images) > 5 THEN 'many_images' END AS code FROM image_bank)
           WHERE code IS NOT NULL GROUP BY code""",
)

# --- Parts of the bank and the log --------------------------------------------

ORACLES["questions_of_topics"] = """
    SELECT p_partkey AS question_id, p_partkey::VARCHAR AS question_number, p_type AS topic
    FROM part WHERE p_type IN ('PROMO', 'SMALL')"""
ORACLES["answered_bank"] = sql(
    ["questions", "answers"],
    "SELECT question_id, topic FROM questions WHERE question_id IN (SELECT question_id FROM answers)",
)
ORACLES["questions_with_images"] = sql(
    ["image_bank"],
    "SELECT question_id, CAST(len(images) AS INT) AS n_images FROM image_bank WHERE len(images) > 0",
)
ORACLES["learners"] = "SELECT DISTINCT user_id AS username FROM events"
ORACLES["repeated_topics"] = sql(
    ["shown", "questions"],
    """SELECT username, min(topic) AS topic FROM (
           SELECT *, row_number() OVER (PARTITION BY username ORDER BY shown_at DESC, id DESC) AS age FROM shown)
       JOIN questions USING (question_id) WHERE age <= 3
       GROUP BY username HAVING count(*) = 3 AND min(topic) = max(topic)""",
)
ORACLES["next_topic"] = sql(
    ["perf"],
    f"""SELECT username, topic FROM (SELECT *, row_number() OVER (PARTITION BY username
        ORDER BY level, accuracy, topic) AS r FROM ({_masteries('perf')})) WHERE r = 1""",
)

# --- Exams -------------------------------------------------------------------

_PROGRESS = """
    SELECT username, q.reconstruction_name AS name, count(DISTINCT question_id) AS answered,
           CAST(count(*) FILTER (is_correct) AS BIGINT) AS correct
    FROM answers JOIN questions q USING (question_id)
    WHERE q.reconstruction_name IS NOT NULL GROUP BY username, q.reconstruction_name"""
_TOTALS = """
    SELECT reconstruction_name AS name, count(*) AS total FROM questions
    WHERE reconstruction_name IS NOT NULL GROUP BY reconstruction_name"""

ORACLES["exam_names"] = """
    SELECT DISTINCT p_brand AS reconstruction_name FROM part WHERE p_size <= 25"""
ORACLES["exam_order"] = """
    SELECT p_brand AS reconstruction_name, p_partkey AS reconstruction_order, p_partkey AS question_id
    FROM part WHERE p_size <= 25"""
ORACLES["exam_progress"] = sql(
    ["answers", "questions"],
    f"""SELECT username, name, total, answered, correct,
        round(correct * 100.0::DOUBLE / answered, 6) AS accuracy,
        round(answered * 100.0::DOUBLE / total, 6) AS progress
        FROM ({_PROGRESS}) JOIN ({_TOTALS}) USING (name)""",
)
ORACLES["exam_progress_complete"] = sql(
    ["users", "questions"],
    f"""SELECT username, name, total, coalesce(answered, 0) AS answered, coalesce(correct, 0) AS correct,
        round(CASE WHEN answered > 0 THEN correct * 100.0::DOUBLE / answered ELSE 0 END, 6) AS accuracy,
        round(coalesce(answered, 0) * 100.0::DOUBLE / total, 6) AS progress
        FROM users CROSS JOIN ({_TOTALS}) LEFT JOIN ({_PROGRESS}) USING (username, name)""",
)

# --- De-duplication and enrichment -------------------------------------------

_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _prefix_key(column: str) -> str:
    return f"lower(regexp_replace(substr({column}, 1, 100), '^{_SPACES}|{_SPACES}$', '', 'g'))"


ORACLES["text_deduplicated"] = f"""
    SELECT source_rank, ordinal, source_file FROM (
        SELECT *, row_number() OVER (PARTITION BY {_prefix_key('text')} ORDER BY source_rank, ordinal) AS r
        FROM (SELECT 0 AS source_rank, doc_id AS ordinal, source AS source_file, text FROM documents
              UNION ALL SELECT 1, item_id, 'benchmark', text FROM benchmark))
    WHERE r = 1"""
ORACLES["first_of_each_length"] = """
    SELECT n_chars AS question_id, min(doc_id) AS ordinal, arg_min(source, doc_id) AS source_file
    FROM documents GROUP BY n_chars"""
ORACLES["repeated_ids"] = """
    SELECT n_chars AS question_id, first_ordinal, first_source, doc_id AS duplicate_ordinal,
           source AS duplicate_source
    FROM documents JOIN (SELECT n_chars, min(doc_id) AS first_ordinal, arg_min(source, doc_id) AS first_source
                         FROM documents GROUP BY n_chars) USING (n_chars)
    WHERE doc_id > first_ordinal"""
ORACLES["topic_merge"] = sql(["merged"], "SELECT question_id, topic, topic_source FROM merged")
ORACLES["topic_merge_counters"] = sql(
    ["merged"], "SELECT topic_source, count(*) AS n FROM merged GROUP BY topic_source"
)
ORACLES["unclassified_report"] = sql(
    ["merged"],
    """SELECT question_id, substr(question_text, 1, 100) AS question_text, source_type FROM merged
       WHERE topic_source = 'still_unclassified'""",
)
ORACLES["topics_outside_list"] = """
    SELECT doc_id AS question_id, lang AS topic FROM documents WHERE lang = 'de'"""

# --- Classifier answers ------------------------------------------------------

_TOPIC_LIST = "[" + ", ".join(f"'{t}'" for t in S.VALID_TOPICS) + "]"
_CLASSIFIED = f"""
    SELECT doc_id AS question_id,
        CASE WHEN doc_id % 8 IN (0, 1, 2, 3, 5) THEN category ELSE 'Medicina Legal' END AS category,
        CASE doc_id % 8 WHEN 0 THEN conf WHEN 1 THEN conf WHEN 2 THEN conf * 0.9 WHEN 3 THEN 0.5
             WHEN 4 THEN 0.3 WHEN 5 THEN 0.5 ELSE 0.1 END AS confidence
    FROM (SELECT doc_id, {_TOPIC_LIST}[place + 1] AS category, round((place + 1) / 20.0::DOUBLE, 2) AS conf
          FROM (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS place FROM documents))"""
ORACLES["classified_responses"] = (
    f"SELECT question_id, category, round(confidence::DOUBLE, 6) AS confidence FROM ({_CLASSIFIED})"
)
ORACLES["category_summary"] = f"""
    SELECT category, n, round(avg_confidence, 6) AS avg_confidence,
           round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct,
           CASE WHEN avg_confidence >= 0.8 THEN 'high' WHEN avg_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band
    FROM (SELECT category, count(*) AS n, avg(confidence::DOUBLE) AS avg_confidence FROM ({_CLASSIFIED}) GROUP BY category)"""
ORACLES["confidence_histogram"] = f"""
    SELECT band, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct
    FROM (SELECT CASE WHEN confidence::DOUBLE >= 0.8 THEN 'high' WHEN confidence::DOUBLE >= 0.5 THEN 'medium'
                 ELSE 'low' END AS band FROM ({_CLASSIFIED})) GROUP BY band"""
ORACLES["categories_attached"] = """
    SELECT d.doc_id AS question_id,
           CASE WHEN l.doc_id IS NULL THEN 'Medicina Legal' ELSE 'h' || l.quality END AS topic,
           CASE WHEN l.doc_id IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS topic_confidence
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
ORACLES["not_yet_classified"] = """
    SELECT doc_id AS question_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""

_PROMPT_TOPICS = "\n".join(f"- {t}" for t in S.VALID_TOPICS)
_PROMPT = PROMPT.replace("'", "''").split("%s")
_PROMPT_SQL = (
    f"'{_PROMPT[0]}' || '{_PROMPT_TOPICS}' || '{_PROMPT[1]}' || text || '{_PROMPT[2]}' || source"
    f" || '{_PROMPT[3]}' || lang || '{_PROMPT[4]}'"
)
ORACLES["classifier_prompts"] = f"SELECT doc_id AS question_id, md5({_PROMPT_SQL}) AS prompt_md5 FROM documents"

# --- Validation --------------------------------------------------------------

_BLANK = f"regexp_replace(text, '{_SPACES}', '', 'g') = ''"


def _findings(kinds: list[tuple[str, str, str]]) -> str:
    parts = [
        f"SELECT doc_id AS question_id, '{code}' AS code, '{path}' AS path FROM documents WHERE {test}"
        for code, path, test in kinds
    ]
    return " UNION ALL ".join(parts)


_COMMON_FINDINGS = [
    ("empty_text", "question_text", _BLANK),
    ("options_not_list", "answer_options", "doc_id % 8 = 1"),
    ("no_options", "answer_options", "doc_id % 8 = 2"),
    ("no_correct_option", "answer_options", "doc_id % 8 = 3"),
    ("many_correct_options", "answer_options", "doc_id % 8 = 4"),
    ("option_not_object", "answer_options[2]", "doc_id % 8 = 5"),
    ("option_field_missing", "answer_options[3].text", "doc_id % 8 = 5"),
    ("option_field_missing", "answer_options[3].is_correct", "doc_id % 8 = 5"),
    ("field_missing", "question_number", "doc_id % 8 = 6"),
]
_IMPORT_FINDINGS = _findings(
    [*_COMMON_FINDINGS, ("empty_topic", "topic", "lang NOT IN ('fr', 'de')")]
)
ORACLES["import_findings"] = _IMPORT_FINDINGS
ORACLES["strict_findings"] = _findings(
    [
        *_COMMON_FINDINGS,
        ("image_not_string", "images[1]", "doc_id % 8 = 7"),
        ("exam_fields_not_both", "reconstruction_name", "doc_id % 8 = 0"),
    ]
)
ORACLES["finding_histogram"] = f"SELECT code, count(*) AS n FROM ({_IMPORT_FINDINGS}) GROUP BY code"
ORACLES["import_report"] = f"""
    WITH f AS (SELECT question_id, count(*) AS n FROM ({_IMPORT_FINDINGS}) GROUP BY question_id)
    SELECT count(*) FILTER (f.n IS NULL) AS valid, count(*) FILTER (f.n IS NOT NULL) AS invalid,
           count(*) FILTER (f.n IS NULL AND doc_id % 8 = 7) AS with_images,
           count(*) FILTER (f.n IS NULL AND doc_id % 8 = 0) AS exam_rows,
           CAST(coalesce(sum(f.n), 0) AS BIGINT) AS issues, 0::BIGINT AS skipped
    FROM documents LEFT JOIN f ON f.question_id = doc_id"""

# --- Images ------------------------------------------------------------------

ORACLES["images_rewritten"] = sql(
    ["image_bank", "image_rows"],
    """SELECT b.question_id, coalesce(r.images, '') AS images FROM image_bank b LEFT JOIN (
       SELECT question_id, string_agg(CASE WHEN status = 'replaced' THEN 'store:' || url ELSE url END, ' '
              ORDER BY pos) AS images FROM image_rows GROUP BY question_id) r USING (question_id)""",
)
ORACLES["image_counters"] = sql(
    ["image_rows"],
    """SELECT count(*) AS total_images, count(*) FILTER (status = 'replaced') AS replaced,
       count(*) FILTER (status = 'not_found') AS not_found,
       count(*) FILTER (status = 'already_hosted') AS already_hosted FROM image_rows""",
)
ORACLES["image_migration_status"] = sql(
    ["image_rows"],
    """SELECT count(*) AS total, count(*) FILTER (status = 'already_hosted') AS already_hosted,
       count(*) FILTER (status = 'replaced') AS in_map, count(*) FILTER (status = 'not_found') AS pending,
       count(*) FILTER (status <> 'not_found') AS migrated FROM image_rows WHERE status <> 'empty'""",
)
ORACLES["images_to_move"] = sql(
    ["image_rows"],
    """SELECT question_id, CAST(pos AS INT) AS pos, url, question_id || '_' || (pos + 1) ||
       coalesce(nullif(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.].*?(\\.[^.]+)$', 1), ''), '.jpg')
       AS storage_name FROM image_rows WHERE status = 'not_found'""",
)
ORACLES["page_links"] = sql(
    ["image_bank"],
    "SELECT question_id AS page_id, array_to_string(images, ' ') AS links FROM image_bank",
)
ORACLES["page_file_names"] = r"""
    SELECT page_id, file_name, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') || '_1' ||
           coalesce(nullif(regexp_extract(file_name, '[^.].*?(\.[^.]+)$', 1), ''), '.jpg') AS storage_name
    FROM (SELECT page_id, url,
          regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '([^/]*)$', 1) AS file_name
          FROM pages)"""

# --- HTML extraction ---------------------------------------------------------


def _quiz(correct: str, right_flags: tuple[str, str, str], id_expr: str, more: str = "", where: str = "") -> str:
    flags = right_flags
    return f"""
    SELECT {id_expr} AS question_id, CAST(p_partkey AS VARCHAR) AS question_number, '' AS topic,
           p_name || ' ' || p_type AS question_text,
           'a.|' || p_type || '||' || {flags[0]} || ';b.|' || p_name || '||' || {flags[1]} ||
               ';c.|otra & más||' || {flags[2]} AS answer_options,
           {correct} AS correct_answer, 'Ver ' || p_brand AS explanation,
           '/img/' || p_partkey || '.png' AS images{more}
    FROM part {where}"""


_RAW_ID = "CASE WHEN p_size % 2 = 1 THEN 'q-' ELSE 'question-' END || p_size || '-' || p_partkey"
ORACLES["quiz_page_questions"] = _quiz("'b. ' || p_name", ("'false'", "'true'", "'false'"), _RAW_ID)
_TYPE_WINS = "(contains(lower(p_name) || '.', lower(p_type)))"
ORACLES["exam_page_questions"] = _quiz(
    f"CASE WHEN {_TYPE_WINS} THEN 'a. ' || p_type ELSE 'b. ' || p_name END",
    (f"{_TYPE_WINS}::VARCHAR", f"(NOT {_TYPE_WINS})::VARCHAR", "'false'"),
    f"'exam_quiz_' || regexp_replace(lower(p_brand), '[^a-zA-Z0-9_]', '_', 'g') || '_' || {_RAW_ID}",
    """, p_brand AS reconstruction_name,
       row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS reconstruction_order""",
)
ORACLES["exam_numbers_as_published"] = """
    SELECT p_brand AS reconstruction_name, CAST(p_partkey AS VARCHAR) AS question_number,
           row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + p_size % 2 AS reconstruction_order
    FROM part"""
ORACLES["accordion_page_questions"] = """
    SELECT p_brand || '_' || p_partkey AS question_id, CAST(p_partkey AS VARCHAR) AS question_number,
           p_brand AS topic, p_name || '?' AS question_text,
           'a.|' || p_name || '|porque no: nunca|false;b.|' || p_type || '|por qué|true;d.|' || p_name
               || '||false' AS answer_options,
           'b. ' || p_type AS correct_answer, 'Ver "' || p_name AS explanation,
           '/i/' || p_partkey || '.jpg' AS images
    FROM part"""
ORACLES["plain_page_items"] = """
    SELECT page_id, CAST(len(regexp_extract_all(html, 'class="que[^"]*multichoice|id="question-[0-9]+-[0-9]+')) AS BIGINT) AS items
    FROM pages"""

_TEXT_KEY = "lower(trim(substr(question_text, 1, 100)))"
ORACLES["bank_from_pages"] = f"""
    WITH s AS MATERIALIZED (
        SELECT 0 AS rank, p_brand AS folder, p_partkey AS place, p_name || ' ' || p_type AS question_text,
               'exam_quiz_' || regexp_replace(lower(p_brand), '[^a-zA-Z0-9_]', '_', 'g') || '_' || {_RAW_ID} AS question_id,
               '' AS topic, 'exam' AS source_type FROM part
        UNION ALL SELECT 1, p_brand, p_partkey, p_name || '?', p_brand || '_' || p_partkey, p_brand, 'course' FROM part
        UNION ALL SELECT 2, p_brand, p_partkey, p_name || ' ' || p_type, {_RAW_ID}, '', 'quiz' FROM part)
    SELECT question_id, question_text, CASE WHEN topic = '' THEN 'Sin clasificar' ELSE topic END AS topic,
           CASE WHEN topic = '' THEN 'still_unclassified' ELSE 'already_had_topic' END AS topic_source,
           source_type, lpad(place::VARCHAR, 12, '0') || '.html' AS source_file
    FROM (SELECT *, row_number() OVER (PARTITION BY {_TEXT_KEY} ORDER BY rank, folder, place) AS r FROM s)
    WHERE r = 1"""
_VALID_RAW = f"lang IN ('fr', 'de') AND doc_id % 8 IN (0, 7) AND NOT ({_BLANK})"
ORACLES["bank_import"] = f"""
    SELECT CAST(doc_id AS VARCHAR) AS question_id,
           CASE WHEN {_VALID_RAW} THEN lang ELSE 'h' || quality END AS topic,
           CASE WHEN {_VALID_RAW} THEN 2 END AS n_options,
           CASE WHEN {_VALID_RAW} THEN lang END AS source_type,
           CASE WHEN {_VALID_RAW} AND doc_id % 8 = 0 THEN 'exam' END AS reconstruction_name
    FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR ({_VALID_RAW})"""

# --- Keyed tables ------------------------------------------------------------

ORACLES["bank_upsert"] = sql(
    ["bank"],
    """SELECT b.question_id,
       CASE WHEN l.doc_id IS NULL THEN b.topic WHEN l.toxic = 1 THEN 'second' ELSE 'first' END AS topic,
       CASE WHEN l.doc_id IS NULL THEN b.question_text ELSE 'changed' END AS question_text,
       l.doc_id IS NULL AS is_new_or_untouched
       FROM bank b LEFT JOIN labels l ON l.doc_id = b.question_id
       UNION ALL SELECT -1 - item_id, 'new', text, true FROM benchmark""",
)
_CARD_OUTCOMES = """
    SELECT c.username, c.id, CASE WHEN EXISTS (
        SELECT 1 FROM cards a WHERE NOT a.archived AND a.username = c.username AND a.front_text = c.front_text)
        OR row_number() OVER (PARTITION BY c.username, c.front_text ORDER BY c.id) > 1
        THEN 'skipped' ELSE 'inserted' END AS outcome FROM cards c"""
ORACLES["cards_inserted"] = sql(["cards"], _CARD_OUTCOMES)
ORACLES["card_outcomes"] = sql(
    ["cards"], f"SELECT outcome, count(*) AS n FROM ({_CARD_OUTCOMES}) GROUP BY outcome"
)
ORACLES["active_cards"] = sql(
    ["cards"], "SELECT username, id, front_text FROM cards WHERE NOT archived"
)
ORACLES["cards_updated"] = sql(
    ["cards"],
    """SELECT c.username, c.id, CASE WHEN a.id IS NULL THEN c.front_text ELSE a.new_front END AS front_text,
       CASE WHEN a.id IS NULL THEN c.back_text ELSE 'seen' END AS back_text,
       CASE WHEN a.id IS NULL THEN c.topic ELSE 't' END AS topic, c.archived
       FROM cards c LEFT JOIN applied a ON a.username = c.username AND a.id = c.id""",
    {
        "wanted": """SELECT username, id, substr(front_text, 1, 6) AS new_front, row_number() OVER (
                     PARTITION BY username, substr(front_text, 1, 6) ORDER BY id) AS r FROM cards WHERE archived""",
        "applied": """SELECT * FROM wanted w WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM cards c
                      WHERE c.username = w.username AND c.front_text = w.new_front AND c.id <> w.id)""",
    },
)
ORACLES["cards_archived"] = sql(
    ["cards"], "SELECT username, id, archived OR length(back_text) > 400 AS archived FROM cards"
)
ORACLES["progress_reset"] = sql(
    ["dperf", "cards"],
    """SELECT 'answers' AS "table", count(*) AS n FROM dense WHERE username NOT IN (SELECT username FROM gone)
       UNION ALL SELECT 'performance', count(*) FROM dperf WHERE username NOT IN (SELECT username FROM gone)
       UNION ALL SELECT 'reviews', count(*) FROM events WHERE user_id NOT IN (SELECT username FROM gone)
       UNION ALL SELECT 'cards', count(*) FROM cards""",
    {"gone": "SELECT DISTINCT username FROM dperf WHERE streak >= 2 AND priority_score < -5"},
)
ORACLES["cards_exported"] = sql(
    ["cards"], "SELECT username, id AS ordinal, front_text, back_text FROM cards WHERE NOT archived"
)

# --- Sampling and recommendation ---------------------------------------------

_W1 = "CASE WHEN priority_score > 0 THEN greatest(priority_score, 0.1) ELSE 0.5 END::DOUBLE"
_W2 = """CASE WHEN priority_score > 0 THEN priority_score
    ELSE abs(greatest(priority_score, -10.0)) * 0.1::DOUBLE + 0.5::DOUBLE END::DOUBLE"""

ORACLES["uniform_sample"] = f"""
    SELECT p_partkey AS question_id FROM part ORDER BY {uniform(SEED, 'p_partkey')}, p_partkey LIMIT 50"""
ORACLES["random_question_with_image"] = sql(
    ["image_bank"],
    f"""SELECT question_id FROM image_bank WHERE len(images) > 0
        ORDER BY {uniform(SEED, 'question_id')}, question_id LIMIT 1""",
)
ORACLES["weighted_question"] = sql(
    ["dperf"],
    f"""SELECT username, arg_min(question_id, -ln({uniform(SEED, 'username', 'question_id')}) / ({_W2}))
        AS question_id FROM dperf GROUP BY username""",
)
_RECENT = """SELECT *, row_number() OVER (PARTITION BY username ORDER BY shown_at DESC, id DESC) AS age FROM"""
ORACLES["recent_questions"] = sql(
    ["shown"],
    f"SELECT DISTINCT username, question_id FROM ({_RECENT} shown) WHERE age <= 10",
)
ORACLES["recent_questions_stream"] = ORACLES["recent_questions"]
ORACLES["repeated_topics_stream"] = ORACLES["repeated_topics"]


def _weights(weight: str, unseen: float, digits: bool) -> str:
    w = f"round({weight}, 6)" if digits else weight
    return f"""SELECT username, question_id, {w} AS weight, 1::BIGINT AS n_questions FROM dperf
       UNION ALL SELECT username, NULL, {unseen}::DOUBLE,
           (SELECT count(*) FROM questions) - (SELECT count(*) FROM dperf p WHERE p.username = u.username)
       FROM users u"""


ORACLES["session_weights"] = sql(["dperf", "users"], _weights(_W1, 5.0, False))
ORACLES["topic_weights"] = sql(["dperf", "users"], _weights(_W2, 3.0, True))

_BANK_SIZE = "(SELECT count(*) FROM questions)"
_RANDOM = f"""
    SELECT u.username, i.question_id FROM users u
    JOIN idx i ON i.pos = CAST(floor({uniform(SEED + '{}/place', 'u.username', _BANK_SIZE + ' - 1')} * {_BANK_SIZE}) AS BIGINT)"""
ORACLES["next_random"] = sql(["users", "idx"], _RANDOM.format(""))
ORACLES["next_unanswered"] = sql(
    ["users", "idx"],
    "SELECT username, question_id FROM d JOIN idx ON d.place = idx.pos",
    {
        "known": """SELECT DISTINCT username, pos AS place, NULL::DOUBLE AS weight
                    FROM answers JOIN idx USING (question_id)""",
        "targets": f"SELECT username, {_BANK_SIZE} AS size, 1 AS picks, 1.0::DOUBLE AS free_weight FROM users",
        **draw("targets", "known", ["username"], SEED, "d"),
    },
)


def _of_largest_topic(statement: str) -> str:
    """The statement over the questions of the topic that has most of them."""
    bank = f"questions AS MATERIALIZED ({VIEWS['questions']})"
    assert bank in statement
    largest = "(SELECT topic FROM all_questions GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 1)"
    few = f"questions AS MATERIALIZED (SELECT * FROM all_questions WHERE topic = {largest})"
    return statement.replace(bank, f"all_{bank},\n{few}")


ORACLES["next_random_of_topic"] = _of_largest_topic(ORACLES["next_random"])
ORACLES["next_unanswered_of_topic"] = _of_largest_topic(
    sql(
        ["users", "idx"],
        f"""SELECT * FROM fresh UNION ALL SELECT * FROM ({_RANDOM.format('/random')})
            WHERE username NOT IN (SELECT username FROM fresh)""",
        {
            "known": """SELECT DISTINCT username, pos AS place, NULL::DOUBLE AS weight
                        FROM answers JOIN idx USING (question_id)""",
            "targets": f"SELECT username, {_BANK_SIZE} AS size, 1 AS picks, 1.0::DOUBLE AS free_weight FROM users",
            **draw("targets", "known", ["username"], SEED, "d"),
            "fresh": "SELECT username, question_id FROM d JOIN idx ON d.place = idx.pos",
        },
    )
)
ORACLES["next_weakest"] = sql(
    ["dperf", "users", "idx"],
    f"""SELECT * FROM weak UNION ALL SELECT * FROM ({_RANDOM.format('/random')})
        WHERE username NOT IN (SELECT username FROM weak)""",
    {
        "weak": f"""SELECT username, arg_min(question_id, -ln({uniform(SEED, 'username', 'question_id')})) AS question_id
                    FROM dperf WHERE incorrect_attempts > correct_attempts GROUP BY username"""
    },
)
ORACLES["next_in_topic"] = sql(
    ["perf", "idx", "sizes"],
    "SELECT username, topic, question_id FROM d JOIN idx USING (topic) WHERE d.place = idx.idx",
    {
        "known": f"SELECT username, idx.topic, idx AS place, {_W2} AS weight FROM perf JOIN idx USING (question_id)",
        "targets": """SELECT DISTINCT username, topic, n AS size, 1 AS picks, 3.0::DOUBLE AS free_weight
                      FROM perf JOIN sizes USING (topic)""",
        **draw("targets", "known", ["username", "topic"], SEED, "d"),
    },
)


def _open_topics(perf: str) -> dict[str, str]:
    return {
        "open_topics": f"""
        SELECT m.username, m.topic, level, accuracy, s.n AS size, s.n - coalesce(d.n, 0) AS available
        FROM ({_masteries(perf)}) m JOIN sizes s USING (topic)
        LEFT JOIN (SELECT username, topic, count(*) AS n FROM {perf}
                   WHERE streak >= 2 AND priority_score < -5 GROUP BY ALL) d
             ON d.username = m.username AND d.topic = m.topic
        WHERE level < 5 AND s.n - coalesce(d.n, 0) > 0""",
        "known": f"""
        SELECT username, idx.topic, idx AS place,
               CASE WHEN streak >= 2 AND priority_score < -5 THEN NULL ELSE {_W2} END AS weight
        FROM {perf} JOIN idx USING (question_id)""",
    }


ORACLES["next_topic_first"] = sql(
    ["perf", "users", "idx", "sizes"],
    f"""SELECT * FROM picked UNION ALL SELECT * FROM ({_RANDOM.format('/random')})
        WHERE username NOT IN (SELECT username FROM picked)""",
    {
        **_open_topics("perf"),
        "targets": """SELECT username, topic, size, 1 AS picks, 3.0::DOUBLE AS free_weight FROM (
            SELECT *, row_number() OVER (PARTITION BY username ORDER BY level, accuracy, topic) AS r
            FROM open_topics) WHERE r = 1""",
        **draw("targets", "known", ["username", "topic"], SEED, "d"),
        "picked": "SELECT username, question_id FROM d JOIN idx USING (topic) WHERE d.place = idx.idx",
    },
)
ORACLES["next_adaptive"] = sql(
    ["dperf", "users", "idx", "sizes", "shown"],
    """SELECT d.username, i.question_id FROM d JOIN base b USING (username)
       JOIN idx i ON i.pos = CASE WHEN b.avoid IS NOT NULL AND d.place >= b.start THEN d.place + b.n ELSE d.place END""",
    {
        "dshown": "SELECT id, username, question_id % 10 AS question_id, shown_at FROM shown",
        "aged": f"{_RECENT} dshown",
        "recent": "SELECT DISTINCT username, question_id, topic, pos FROM aged JOIN idx USING (question_id) WHERE age <= 10",
        "tired": f"""
        SELECT username, topic FROM (
            SELECT username, min(topic) AS topic FROM aged JOIN idx USING (question_id) WHERE age <= 3
            GROUP BY username HAVING count(*) = 3 AND min(topic) = max(topic))
        JOIN ({_micro('dperf')}) USING (username, topic)
        WHERE accuracy > 60 AND {uniform(SEED + '/coin', 'username')} < 0.8::DOUBLE""",
        "base0": f"""
        SELECT username, n_shown, {_BANK_SIZE} - n_shown >= 5 AS skip_shown, avoid, n, start, n_elsewhere FROM (
            SELECT u.username, count(r.question_id) AS n_shown, any_value(t.topic) AS avoid, any_value(s.n) AS n,
                   any_value(s.start) AS start, count(r.question_id) FILTER (r.topic <> t.topic) AS n_elsewhere
            FROM users u LEFT JOIN recent r USING (username) LEFT JOIN tired t ON t.username = u.username
            LEFT JOIN sizes s ON s.topic = t.topic GROUP BY u.username)""",
        "base": f"""
        SELECT username, skip_shown, n, start,
               CASE WHEN {_BANK_SIZE} - n - CASE WHEN skip_shown THEN n_elsewhere ELSE 0 END > 0 THEN avoid END AS avoid
        FROM base0""",
        "listed": f"""
        SELECT username, question_id, max(weight) AS weight, max(is_shown) AS is_shown FROM (
            SELECT username, question_id, {_W1} AS weight, 0 AS is_shown FROM dperf
            UNION ALL SELECT username, question_id, NULL, 1 FROM recent) GROUP BY ALL""",
        "known": """
        SELECT username, CASE WHEN b.avoid IS NOT NULL AND i.pos >= b.start THEN i.pos - b.n ELSE i.pos END AS place,
               CASE WHEN is_shown = 1 AND skip_shown THEN NULL ELSE weight END AS weight
        FROM listed JOIN idx i USING (question_id) JOIN base b USING (username)
        WHERE (b.avoid IS NULL OR i.topic <> b.avoid) AND (weight IS NOT NULL OR skip_shown)""",
        "targets": f"""
        SELECT username, {_BANK_SIZE} - CASE WHEN avoid IS NOT NULL THEN n ELSE 0 END AS size, 1 AS picks,
               5.0::DOUBLE AS free_weight FROM base""",
        **draw("targets", "known", ["username"], SEED, "d"),
    },
)
ORACLES["exam_paper_mixed"] = sql(
    ["users", "idx"],
    f"""SELECT username, CAST(row_number() OVER (PARTITION BY username
            ORDER BY {uniform(SEED + '/order', 'username', 'place')}, place) AS INT) AS rank, question_id
        FROM (SELECT username, unnest({floyd(_BANK_SIZE, str(EXAM_SIZE), SEED, 'username')}) AS place FROM users)
        JOIN idx ON idx.pos = place""",
)
ORACLES["exam_paper_challenging"] = sql(
    ["perf", "users", "idx", "sizes"],
    """SELECT username, question_id FROM picked UNION ALL
       SELECT username, question_id FROM f JOIN idx ON idx.pos = f.place""",
    {
        **_open_topics("perf"),
        "targets": f"""
        SELECT username, topic, size, least(available, {EXAM_SIZE} - taken)::BIGINT AS picks, 3.0::DOUBLE AS free_weight
        FROM (SELECT *, coalesce(sum(available) OVER (PARTITION BY username ORDER BY level, accuracy, topic
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS taken FROM open_topics)
        WHERE taken < {EXAM_SIZE}""",
        **draw("targets", "known", ["username", "topic"], SEED, "d"),
        "picked": "SELECT username, question_id, pos FROM d JOIN idx USING (topic) WHERE d.place = idx.idx",
        "fknown": "SELECT username, pos AS place, NULL::DOUBLE AS weight FROM picked",
        "ftargets": f"""
        SELECT username, {_BANK_SIZE} AS size, {EXAM_SIZE} - count(p.pos) AS picks, 1.0::DOUBLE AS free_weight
        FROM users LEFT JOIN picked p USING (username) GROUP BY username HAVING count(p.pos) < {EXAM_SIZE}""",
        **draw("ftargets", "fknown", ["username"], SEED + "/fill", "f"),
    },
)
ORACLES["exam_paper_balanced"] = sql(
    ["dperf", "users", "idx"],
    """SELECT username, question_id FROM weak UNION ALL
       SELECT username, question_id FROM f JOIN idx ON idx.pos = f.place""",
    {
        "weak": f"""
        SELECT username, question_id, pos FROM (
            SELECT username, question_id, pos, row_number() OVER (PARTITION BY username
                ORDER BY {uniform(SEED + '/weak', 'username', 'question_id')}, question_id) AS r
            FROM dperf JOIN idx USING (question_id) WHERE incorrect_attempts > correct_attempts)
        WHERE r <= {EXAM_SIZE // 3}""",
        "fknown": "SELECT username, pos AS place, NULL::DOUBLE AS weight FROM weak",
        "ftargets": f"""
        SELECT username, {_BANK_SIZE} AS size,
               {EXAM_SIZE} - (SELECT count(*) FROM weak w WHERE w.username = users.username) AS picks,
               1.0::DOUBLE AS free_weight FROM users""",
        **draw("ftargets", "fknown", ["username"], SEED + "/rest", "f"),
    },
)
