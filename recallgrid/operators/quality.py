"""Validation of raw question JSON and checks that stop a job.

Rules work on the raw JSON string as a variant value, because a missing field,
a null field and a field of the wrong type are three different findings. Each
rule gives a code, so a row ends up with an array of codes and no text parsing
is needed to count them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid import schemas as S
from recallgrid.functions.text import NOT_SPACE

ISSUE_TYPE = "array<struct<code:string,path:string>>"


def _get(value: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(value, path, as_type)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _absent(value: Column, field: str) -> Column:
    return _get(value, f"$.{field}").isNull()


def _null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _truthy(value: Column) -> Column:
    """The flag test of the source data: any non-empty value but false and zero."""
    text = value.cast("string")
    empty = text.isin("", "[]", "{}") | (
        (_kind(value) != "STRING") & text.isin("false", "0", "0.0", "-0.0")
    )
    return ~_null(value) & ~F.coalesce(empty, F.lit(False))


def _blank(value: Column) -> Column:
    """No text: missing, null or only white space."""
    return _null(value) | ~value.cast("string").rlike(NOT_SPACE)


def _issue(condition: Column, code: str, path: Column | str) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(condition, F.struct(F.lit(code).alias("code"), path.alias("path")))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(_kind(value).startswith(kind), F.lit(False))


def _option_issues(options: Column) -> Column:
    def of_option(option: Column, i: Column) -> Column:
        where = F.concat(F.lit("answer_options["), i.cast("string"), F.lit("]"))
        is_object = _is(option, "OBJECT")
        missing = [
            _issue(is_object & _absent(option, f), "option_field_missing", F.concat(where, F.lit(f".{f}")))
            for f in S.OPTION_REQUIRED_FIELDS
        ]
        return F.array_compact(F.array(_issue(~is_object, "option_not_object", where), *missing))

    return F.flatten(F.transform(options, of_option))


def _correct_count(options: Column) -> Column:
    marked = lambda o: _is(o, "OBJECT") & F.coalesce(_truthy(_get(o, "$.is_correct")), F.lit(False))
    return F.size(F.filter(options, marked))


_LIST = "array<variant>"
_FIELDS = list(dict.fromkeys(S.STRICT_REQUIRED_FIELDS + ["reconstruction_name", "reconstruction_order"]))


def _staged(raw: DataFrame, json: str) -> DataFrame:
    """Each JSON string parsed once, each field fetched once (``_<field>``)."""
    parsed = raw.withColumn("_q", F.try_parse_json(json))
    fields = parsed.withColumns({f"_{f}": _get(F.col("_q"), f"$.{f}") for f in _FIELDS})
    lists = fields.withColumns(
        {
            "_option_list": F.when(
                _is(F.col("_answer_options"), "ARRAY"), F.col("_answer_options").cast(_LIST)
            ),
            "_image_list": F.when(_is(F.col("_images"), "ARRAY"), F.col("_images").cast(_LIST)),
        }
    )
    return lists.withColumn("_n_correct", _correct_count(F.col("_option_list")))


def _common_issues(required: list[str]) -> list[Column]:
    options = F.col("_option_list")
    filled = F.size(options) > 0
    return [
        *[_issue(F.col(f"_{f}").isNull(), "field_missing", f) for f in required],
        _issue(_blank(F.col("_question_id")), "empty_id", "question_id"),
        _issue(_blank(F.col("_question_text")), "empty_text", "question_text"),
        _issue(F.size(options) == 0, "no_options", "answer_options"),
        _issue(filled & (F.col("_n_correct") == 0), "no_correct_option", "answer_options"),
        _issue(filled & (F.col("_n_correct") > 1), "many_correct_options", "answer_options"),
        _issue(
            F.col("_images").isNotNull() & F.col("_image_list").isNull(), "images_not_list", "images"
        ),
        *_exam_type_issues(),
    ]


def _exam_type_issues() -> list[Column]:
    name, order = F.col("_reconstruction_name"), F.col("_reconstruction_order")
    return [
        _issue(~_null(name) & ~_is(name, "STRING"), "exam_name_not_string", "reconstruction_name"),
        _issue(
            ~_null(order) & ~_is(order, "BIGINT") & ~_is(order, "BOOLEAN"),
            "exam_order_not_integer",
            "reconstruction_order",
        ),
    ]


def _checked(raw: DataFrame, json: str, singles: list[Column], *lists: Column) -> DataFrame:
    empty = F.array().cast(ISSUE_TYPE)
    found = F.concat(
        F.array_compact(F.array(*singles)),
        *[F.coalesce(issues, empty) for issues in (_option_issues(F.col("_option_list")), *lists)],
    )
    unreadable = F.array(F.struct(F.lit("not_an_object").alias("code"), F.lit("").alias("path")))
    issues = F.when(_is(F.col("_q"), "OBJECT"), found).otherwise(unreadable)
    return _staged(raw, json).select(*raw.columns, issues.alias("issues"))


def check_for_import(raw: DataFrame, json: str = "json") -> DataFrame:
    """Findings of the import check: seven required fields and a usable topic."""
    topic = F.col("_topic")
    singles = [
        *_common_issues(S.IMPORT_REQUIRED_FIELDS),
        _issue(_null(topic) | (_is(topic, "STRING") & _blank(topic)), "empty_topic", "topic"),
        _issue(F.col("_option_list").isNull(), "options_not_list", "answer_options"),
    ]
    return _checked(raw, json, singles)


def check_strictly(raw: DataFrame, json: str = "json") -> DataFrame:
    """Findings of the extraction check: ten required fields, a blank topic is fine.

    A missing options or images field counts as an empty list.
    """
    options = F.col("_answer_options")
    name, order = F.col("_reconstruction_name"), F.col("_reconstruction_order")
    singles = [
        *_common_issues(S.STRICT_REQUIRED_FIELDS),
        _issue(options.isNull(), "no_options", "answer_options"),
        _issue(
            options.isNotNull() & F.col("_option_list").isNull(), "options_not_list", "answer_options"
        ),
        _issue(_null(name) != _null(order), "exam_fields_not_both", "reconstruction_name"),
    ]

    def of_image(image: Column, i: Column) -> Column:
        where = F.concat(F.lit("images["), i.cast("string"), F.lit("]"))
        return _issue(~_is(image, "STRING"), "image_not_string", where)

    per_image = F.array_compact(F.transform("_image_list", of_image))
    return _checked(raw, json, singles, per_image)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine; pass a stored frame, as both sides read it."""
    ok = F.size("issues") == 0
    return checked.where(ok).drop("issues"), checked.where(~ok)


def issue_rows(checked: DataFrame) -> DataFrame:
    # A plain explode would also filter on the issues, and that filter would be
    # pushed below the stages of the check and parse the JSON again and again.
    return (
        checked.select("question_id", F.explode_outer("issues").alias("i"))
        .where(F.col("i").isNotNull())
        .select("question_id", "i.code", "i.path")
    )


def issue_histogram(checked: DataFrame) -> DataFrame:
    """Findings per code, most frequent first."""
    return (
        issue_rows(checked)
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "code")
    )


def import_report(checked: DataFrame, skipped: int = 0) -> DataFrame:
    """Counts of one import run. ``checked`` also has images and reconstruction_name."""
    ok = F.size("issues") == 0
    number = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return checked.agg(
        number(ok).alias("valid"),
        number(~ok).alias("invalid"),
        number(ok & (F.size("images") > 0)).alias("with_images"),
        number(ok & F.col("reconstruction_name").isNotNull()).alias("exam_rows"),
        F.coalesce(F.sum(F.size("issues")), F.lit(0)).cast("bigint").alias("issues"),
        F.lit(skipped).cast("bigint").alias("skipped"),
    )


class CheckFailed(AssertionError):
    """A data check found rows it must not find."""


def require_none(found: DataFrame, what: str, shown: int = 20) -> None:
    """Stop the job if the frame has any row; shows the first few."""
    sample = found.limit(shown + 1).collect()
    if sample:
        lines = [str(row.asDict()) for row in sample[:shown]]
        more = "\n  ..." if len(sample) > shown else ""
        raise CheckFailed(f"{what}:\n  " + "\n  ".join(lines) + more)


def require_rows(frame: DataFrame, what: str) -> None:
    if not frame.limit(1).collect():
        raise CheckFailed(f"{what}: no rows")


def require_count(frame: DataFrame, expected: int, what: str) -> None:
    found = frame.count()
    if found != expected:
        raise CheckFailed(f"{what}: {found} rows, expected {expected}")
