"""Table schemas and the fixed values every operator shares."""

from pyspark.sql import types as T

# --- Fixed values (must stay as they are for results to agree) ---------------

VALID_TOPICS = [
    "Gastroenterología",
    "Nefrología",
    "Cardiología",
    "Infectología",
    "Diabetes",
    "Endocrinología",
    "Respiratorio",
    "Neurología",
    "Reumatología",
    "Hematología",
    "Geriatría",
    "Psiquiatría",
    "Salud Pública",
    "Dermatología",
    "Otorrinolaringología",
    "Oftalmología",
    "Traumatología",
    "Urología",
    "Cirugía",
    "Anestesiología",
    "Obstetricia",
    "Ginecología",
    "Pediatría",
    "Medicina Legal",
]
UNCLASSIFIED = "Sin clasificar"
DEFAULT_CATEGORY = "Medicina Legal"

# Priority score: starting values, step per answer and clamps.
FIRST_CORRECT_PRIORITY = -1.0
FIRST_WRONG_PRIORITY = 5.0
CORRECT_STEP = -2.0
WRONG_STEP = 5.0
PRIORITY_MIN = -10.0
PRIORITY_MAX = 50.0

# Mastery: (level, minimum accuracy %, minimum questions answered, status).
MASTERY_RULES = [
    (5, 90.0, 20, "Maestro"),
    (4, 80.0, 15, "Experto"),
    (3, 70.0, 10, "Avanzado"),
    (2, 60.0, 5, "Intermedio"),
    (1, None, 3, "Principiante"),
]
LEVEL_ZERO_STATUS = "Iniciando"
NOT_STARTED_STATUS = "Sin iniciar"
FILLED_STAR, EMPTY_STAR = "⭐", "☆"

# Selection weights and windows.
WEIGHT_NO_HISTORY = 1.0
WEIGHT_UNSEEN_V1 = 5.0
WEIGHT_UNSEEN_V2 = 3.0
RECENT_QUESTIONS = 10
RECENT_TOPICS = 3
MIN_CANDIDATES = 5
DIVERSITY_ACCURACY = 60.0
DIVERSITY_PROBABILITY = 0.8

PREFIX_LENGTH = 100
IMPORT_REQUIRED_FIELDS = [
    "question_id",
    "question_number",
    "topic",
    "question_text",
    "answer_options",
    "correct_answer",
    "explanation",
]
STRICT_REQUIRED_FIELDS = IMPORT_REQUIRED_FIELDS + ["images", "source_file", "source_type"]
OPTION_REQUIRED_FIELDS = ["letter", "text", "is_correct"]

# --- Schemas -----------------------------------------------------------------

OPTION = T.StructType(
    [
        T.StructField("letter", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("is_correct", T.BooleanType()),
    ]
)

# Columns of a question as read from a JSON bank file.
QUESTION_FILE = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("question_number", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("question_text", T.StringType()),
        T.StructField("answer_options", T.ArrayType(OPTION)),
        T.StructField("correct_answer", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("reconstruction_name", T.StringType()),
        T.StructField("reconstruction_order", T.LongType()),
    ]
)

# The stored bank adds the two maintenance times.
QUESTIONS = T.StructType(
    QUESTION_FILE.fields
    + [
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

ANSWERS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("user_answer", T.StringType()),
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("answered_at", T.TimestampNTZType()),
        T.StructField("response_time_seconds", T.IntegerType()),
    ]
)

PERFORMANCE = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("total_attempts", T.LongType()),
        T.StructField("correct_attempts", T.LongType()),
        T.StructField("incorrect_attempts", T.LongType()),
        T.StructField("last_answered_at", T.TimestampNTZType()),
        T.StructField("streak", T.LongType()),
        T.StructField("priority_score", T.DoubleType()),
    ]
)

FLASHCARD_REVIEWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("reviewed_at", T.TimestampNTZType()),
    ]
)

FLASHCARDS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("front_text", T.StringType()),
        T.StructField("back_text", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("archived", T.BooleanType()),
    ]
)

TOPIC_LOOKUP = T.StructType(
    [T.StructField("question_id", T.StringType()), T.StructField("topic", T.StringType())]
)

CARD_JSON = T.ArrayType(
    T.StructType(
        [
            T.StructField("front_text", T.StringType()),
            T.StructField("back_text", T.StringType()),
            T.StructField("topic", T.StringType()),
        ]
    )
)
