"""Post-processing of classifier answers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid import schemas as S
from recallgrid.functions.text import strip

# Fixed confidences of the fall-back steps.
CONFIDENCE_DEFAULT = 0.5
CONFIDENCE_FACTOR_CONTAINED = 0.9
CONFIDENCE_IN_TEXT = 0.5
CONFIDENCE_NO_MATCH = 0.3
CONFIDENCE_NO_ANSWER = 0.1

# Answer format asked for in a prompt.
PROMPT = """Clasifica la pregunta en una sola de estas categorías:
%s

Responde solo con JSON: {"category": "<categoría>", "confidence": <0.0 a 1.0>}

Pregunta: %s
Respuesta correcta: %s
Explicación: %s"""


def prompts(bank: DataFrame, categories: list[str] = S.VALID_TOPICS) -> DataFrame:
    """One prompt per question, ready to hand to a batch classifier."""
    listed = "\n".join(f"- {c}" for c in categories)
    return bank.select(
        "question_id",
        F.format_string(
            PROMPT, F.lit(listed), "question_text", "correct_answer", "explanation"
        ).alias("prompt"),
    )


def _first_contained(categories: list[str], text: Column) -> Column:
    """The first category of the list that occurs in the text, else null."""
    listed = F.array(*[F.lit(c) for c in categories])
    lowered = F.lower(text)
    return F.try_element_at(F.filter(listed, lambda c: lowered.contains(F.lower(c))), F.lit(1))


def without_fence(response: Column) -> Column:
    """The content of the first code block, or the whole answer."""
    trimmed = strip(response)
    json_block = strip(F.regexp_extract(trimmed, r"(?s)```json(.*?)(?:```|$)", 1))
    any_block = strip(F.regexp_extract(trimmed, r"(?s)```(.*?)(?:```|$)", 1))
    return (
        F.when(trimmed.contains("```json"), json_block)
        .when(trimmed.contains("```"), any_block)
        .otherwise(trimmed)
    )


def parse_responses(
    responses: DataFrame,
    categories: list[str] = S.VALID_TOPICS,
    default: str = S.DEFAULT_CATEGORY,
) -> DataFrame:
    """Answer text to (category, confidence)."""
    staged = (
        responses.withColumn("_text", without_fence(F.col("response")))
        .withColumn("_json", F.try_parse_json("_text"))
        .withColumn("_raw", F.try_variant_get("_json", "$.category", "variant"))
        .withColumn("_conf", F.try_variant_get("_json", "$.confidence", "variant"))
    )
    is_object = F.coalesce(F.schema_of_variant("_json").startswith("OBJECT"), F.lit(False))
    is_text = F.col("_raw").isNull() | F.coalesce(
        F.schema_of_variant("_raw") == "STRING", F.lit(False)
    )
    category = F.coalesce(strip(F.try_variant_get("_json", "$.category", "string")), F.lit(""))
    confidence = F.when(F.col("_conf").isNull(), F.lit(CONFIDENCE_DEFAULT)).otherwise(
        F.try_variant_get("_json", "$.confidence", "double")
    )
    # No answer, JSON that is no object, or fields of the wrong type.
    broken = F.col("response").isNull() | (
        F.col("_json").isNotNull() & (~is_object | ~is_text | confidence.isNull())
    )
    in_category = _first_contained(categories, category)
    in_text = _first_contained(categories, F.col("_text"))
    exact = is_object & category.isin(categories)
    return staged.select(
        "question_id",
        F.when(broken, F.lit(default))
        .when(exact, category)
        .when(is_object & in_category.isNotNull(), in_category)
        .otherwise(F.coalesce(in_text, F.lit(default)))
        .alias("category"),
        F.when(broken, F.lit(CONFIDENCE_NO_ANSWER))
        .when(exact, confidence)
        .when(is_object & in_category.isNotNull(), confidence * CONFIDENCE_FACTOR_CONTAINED)
        .when(in_text.isNotNull(), F.lit(CONFIDENCE_IN_TEXT))
        .otherwise(F.lit(CONFIDENCE_NO_MATCH))
        .alias("confidence"),
    )


def attach_categories(
    bank: DataFrame, classified: DataFrame, default: str = S.DEFAULT_CATEGORY
) -> DataFrame:
    """The bank with topic and topic_confidence; missing ids get the defaults."""
    found = classified.select(
        "question_id",
        F.col("category").alias("_topic"),
        F.col("confidence").alias("topic_confidence"),
    )
    return (
        bank.join(found, "question_id", "left")
        .withColumn("topic", F.coalesce("_topic", F.lit(default)))
        .withColumn(
            "topic_confidence", F.coalesce("topic_confidence", F.lit(CONFIDENCE_DEFAULT))
        )
        .drop("_topic")
    )


def not_yet_classified(bank: DataFrame, classified: DataFrame) -> DataFrame:
    """Resume: questions without a stored result."""
    return bank.join(classified.select("question_id"), "question_id", "left_anti")
