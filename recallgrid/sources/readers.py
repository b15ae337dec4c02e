"""Reading question banks, lookups, image maps and saved pages."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid import schemas as S
from recallgrid.operators.enrich import invalid_topics
from recallgrid.operators.quality import require_none, require_rows


def read_bank(spark: SparkSession, path: str, format: str = "parquet", ordered: bool = True) -> DataFrame:
    """The stored bank, if wanted in the order of the question number (a string).

    The order costs a sort of the whole bank: jobs that only join or count pass ``ordered=False``.
    """
    bank = spark.read.format(format).load(path)
    return bank.orderBy("question_number", "question_id") if ordered else bank


def _raise_unless_absent(error: AnalysisException) -> None:
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


def read_jdbc(spark: SparkSession, table: str, url: str, split_on: str | None = None, **options) -> DataFrame:
    """A table of a relational database; ``split_on`` with bounds reads in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_on is not None:
        reader = reader.option("partitionColumn", split_on)
    return reader.load()


def read_questions_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Question files, JSON arrays or (for large banks, splittable) JSON lines.

    Optional fields that are missing become NULL, images an empty list. Files
    that are broken or hold something else than a list (lines: than objects)
    stop the job.
    """
    require_list(spark, path, lines)
    frame = spark.read.schema(S.QUESTION_FILE).json(path, multiLine=not lines)
    require_rows(frame, f"question file {path}")
    return frame.withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def require_list(spark: SparkSession, path: str, lines: bool = False) -> None:
    """Stop unless every file is one JSON list, or every line that is not blank one JSON object; empty files hold nothing."""
    parsed = F.try_parse_json("value")
    kind = F.schema_of_variant(parsed)
    texts = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), "value")
    found = texts.select(
        "file",
        F.substring("value", 1, 80).alias("start"),
        F.when(parsed.isNull(), "broken").when(~kind.startswith("OBJECT" if lines else "ARRAY"), kind).alias("what"),
    )
    if lines:
        found = found.where(F.trim("start") != "")
    require_none(found.where("what is not null"), f"no list of questions in {path}")


def read_raw_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The same files as one JSON string per question, for validation; see ``require_list``."""
    require_list(spark, path, lines)
    if lines:
        raw = spark.read.text(path).select(F.col("value").alias("json"))
    else:
        whole = spark.read.text(path, wholetext=True)
        items = F.try_variant_get(F.try_parse_json("value"), F.lit("$"), "array<variant>")
        raw = whole.select(F.explode(items).alias("v")).select(F.to_json("v").alias("json"))
    return raw.withColumn("question_id", F.get_json_object("json", "$.question_id"))


def read_image_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {original url: stored url} as two columns; absent file: no rows."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        _raise_unless_absent(error)
        return spark.createDataFrame([], "original_url string, hosted_url string")
    entries = F.from_json("value", "map<string,string>")
    return whole.select(F.explode(entries).alias("original_url", "hosted_url"))


def read_manual_topics(
    spark: SparkSession, path: str, valid: list[str] = S.VALID_TOPICS
) -> DataFrame | None:
    """Hand-made topics from CSV; stops on missing columns or unknown topics."""
    try:
        frame = spark.read.csv(path, header=True)
    except AnalysisException as error:
        _raise_unless_absent(error)
        return None
    missing = {"question_id", "topic"} - set(frame.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    frame = frame.select("question_id", "topic")
    require_none(invalid_topics(frame, valid), f"{path} has invalid topics")
    return with_ordinal(frame)


def read_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Topics of earlier runs; an absent file is an empty lookup."""
    try:
        frame = spark.read.schema(S.TOPIC_LOOKUP).json(path, multiLine=not lines)
    except AnalysisException as error:
        _raise_unless_absent(error)
        none = F.lit(None).cast("struct<file:string,block:bigint,row:bigint>")
        return spark.createDataFrame([], S.TOPIC_LOOKUP).withColumn("ordinal", none)
    return with_ordinal(frame.where(F.coalesce("question_id", F.lit("")) != ""))


def with_ordinal(frame: DataFrame) -> DataFrame:
    """Row order of the files: by name, then place in the file.

    Spark packs files into partitions by size, so the row number alone would
    order small files by that.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return frame.withColumn("ordinal", place)


def read_pages(
    spark: SparkSession,
    path: str,
    recursive: bool = False,
    without: str = "Reconstrucciones",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Saved HTML pages: path, folder, file, stem, html.

    ``folder`` is the module or exam a page belongs to. With ``files_per_batch``
    the pages are a stream: those that are there, then those that are saved later.
    """
    reader = spark.read if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    reader = reader.option("recursiveFileLookup", recursive)
    pages = reader.option("pathGlobFilter", "*.{html,htm}").text(path, wholetext=True)
    path_column = F.col("_metadata.file_path")
    out = pages.select(
        path_column.alias("path"),
        F.element_at(F.split(F.url_decode(path_column), "/"), -2).alias("folder"),
        F.element_at(F.split(F.url_decode(path_column), "/"), -1).alias("source_file"),
        F.col("value").alias("html"),
    ).withColumn("stem", F.regexp_replace("source_file", r"\.[^.]*$", ""))
    return out.where(~F.col("path").contains(without)) if without else out
