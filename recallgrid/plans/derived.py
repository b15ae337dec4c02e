"""Inputs the driver tables do not have, derived from them row by row by Spark.

Nothing here depends on a fixed list of rows, so every input grows with the
tables: JSON questions and classifier answers from documents, saved quiz pages
from parts, image lists from page links.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid import schemas as S
from recallgrid.operators.html_items import DEALT, attribute_values
from recallgrid.plans.fixtures import bank, table
from recallgrid.sources.storage import new_path

STORED_AT = "2024-01-01 00:00:00"
CHANGED_AT = "2025-01-01 00:00:00"

# Links below this path count as already moved to the image store.
HOSTED = "/d"

REPORT_FIELDS = "images array<string>, reconstruction_name string"


def at(time: str):
    return F.lit(time).cast("timestamp_ntz")


def stream_location(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str | None]:
    """Folder and file name pattern to read a table as a stream.

    A table is a folder of files, or a single file of that name.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    first = spark.read.parquet(path).select("_metadata.file_path").limit(1).collect()
    single = bool(first) and first[0][0].endswith(f"/{name}.parquet")
    return (sf_dir, f"{name}.parquet") if single else (path, None)


def time_slices(spark: SparkSession, sf_dir: str, name: str, slices: int, by: str = "ts") -> str:
    """Folder with a table in so many files by time, the earliest with the oldest date of change.

    A file stream reads files in the order of these dates.
    """
    path = new_path(spark, f"{name}-slices")
    rows = table(spark, sf_dir, name)
    rows.repartitionByRange(slices, by).write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    first = min(files.getFileStatus(p).getModificationTime() for p in parts) - 1000 * len(parts)
    for i, part in enumerate(parts):
        files.setTimes(part, first + 1000 * i, -1)
    return path


def benchmark_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.col("text").alias("question_text"),
        F.lit("benchmark").alias("source_file"),
        F.lit("benchmark").alias("source_type"),
        F.col("item_id").alias("ordinal"),
        F.lit("").alias("topic"),
    )


def length_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        F.col("n_chars").alias("question_id"),
        F.col("doc_id").alias("ordinal"),
        F.col("source").alias("source_file"),
    )


def image_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per page; its links stand in for image URLs."""
    pages = table(spark, sf_dir, "pages")
    links = attribute_values(pages, "a", "href", "page_id")
    sites = pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"))
    return links.join(sites, "page_id").select(
        F.col("page_id").alias("question_id"),
        F.col("values").alias("images"),
        F.col("host").alias("source_file"),
        F.when(F.size("values") > 5, F.col("host")).alias("reconstruction_name"),
    )


def image_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link seen on a page with more than five of them has a new address."""
    pages = image_bank(spark, sf_dir).where(F.size("images") > 5)
    urls = pages.select(F.explode("images").alias("original_url")).distinct()
    return urls.withColumn("hosted_url", F.concat(F.lit("store:"), "original_url"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One classifier answer per document, of a form given by its language and source."""
    documents = table(spark, sf_dir, "documents")
    place = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    category = F.element_at(F.array(*[F.lit(t) for t in S.VALID_TOPICS]), place + 1)
    confidence = (place + 1) / F.lit(20.0)
    answer = F.format_string('{"category": "%s", "confidence": %.2f}', category, confidence)
    form = F.pmod(F.col("doc_id"), F.lit(8))
    text = (
        F.when(form == 0, answer)
        .when(form == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .when(form == 2, F.format_string('{"category": "Creo que %s", "confidence": %.2f}', F.lower(category), confidence))
        .when(form == 3, F.concat(F.lit("Se trata de "), F.upper(category)))
        .when(form == 4, F.lit("No lo sé"))
        .when(form == 5, F.format_string('{"category": "Otra", "nota": "%s"}', category))
        .when(form == 6, F.lit("[1, 2]"))
    )
    return documents.select(F.col("doc_id").alias("question_id"), text.alias("response"))


def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per document as raw JSON, with a defect given by its id."""
    b = bank(spark, sf_dir)
    kind = F.pmod(F.col("question_id"), F.lit(8))

    def field(name, value):
        return F.concat(F.lit(f'"{name}":'), value)

    def quoted(value):
        return F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)

    def option(letter, flag):
        return F.lit(f'{{"letter":"{letter}.","text":"{letter}","is_correct":{flag}}}')

    two = F.concat_ws(",", option("a", "true"), option("b", "true"))
    none = F.concat_ws(",", option("a", "false"), option("b", "false"))
    good = F.concat_ws(",", option("a", "true"), option("b", "false"))
    options = (
        F.when(kind == 1, F.lit('"none"'))
        .when(kind == 2, F.lit("[]"))
        .when(kind == 3, F.concat(F.lit("["), none, F.lit("]")))
        .when(kind == 4, F.concat(F.lit("["), two, F.lit("]")))
        .when(kind == 5, F.concat(F.lit("["), good, F.lit(',7,{"letter":"c."}]')))
        .otherwise(F.concat(F.lit("["), good, F.lit("]")))
    )
    fields = F.concat_ws(
        ",",
        field("question_id", quoted(F.col("question_id").cast("string"))),
        F.when(kind != 6, field("question_number", F.lit('"1"'))),
        field("topic", quoted(F.col("topic"))),
        field("question_text", quoted(F.col("question_text"))),
        field("answer_options", options),
        field("correct_answer", F.lit('"a. a"')),
        field("explanation", F.when(kind == 6, F.lit("null")).otherwise(F.lit('""'))),
        field("images", F.when(kind == 7, F.lit('["x.png",3]')).otherwise(F.lit("[]"))),
        field("source_file", quoted(F.col("source_file"))),
        field("source_type", quoted(F.col("source_type"))),
        F.when(kind == 0, field("reconstruction_name", F.lit('"exam"'))),
    )
    return b.select("question_id", F.concat(F.lit("{"), fields, F.lit("}")).alias("json"))


def _div(css: str, *inner):
    return F.concat(F.lit(f'<div class="{css}">'), *inner, F.lit("</div>"))


def _part_pages(spark, sf_dir):
    # The narrow rows are dealt before they grow to pages: a small file is one task's, its pages may be many.
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    tasks = min(DEALT, 4 * spark.sparkContext.defaultParallelism)
    return part.repartition(tasks, *part.columns).withColumns(
        {
            "folder": F.col("p_brand"),
            "stem": F.lpad(F.col("p_partkey").cast("string"), 12, "0"),
            "key": F.col("p_partkey").cast("string"),
        }
    )


def quiz_pages(spark: SparkSession, sf_dir: str, marked: bool = True) -> DataFrame:
    """A saved quiz page per part: its question, after a broken one for odd sizes.

    Pages of large parts were saved as a source listing.
    """

    def row(css, letter, value, right):
        mark = f"{css} correct" if right and marked else css
        return _div(
            mark,
            _div(
                "d-flex",
                F.lit(f'<span class="answernumber">{letter}.</span>'),
                _div("flex-fill ml-1", value),
            ),
        )

    # Odd sizes: the id does not have the usual form and an item without id comes
    # first, so the items are found by class and the first one is not usable.
    odd = F.col("p_size") % 2 == 1
    item = F.concat(
        F.when(odd, F.lit('<div class="que multichoice"></div><div id="q-')).otherwise(
            F.lit('<div id="question-')
        ),
        F.col("p_size").cast("string"),
        F.lit("-"),
        F.col("key"),
        F.lit('" class="que multichoice"><span class="qno">Pregunta '),
        F.col("key"),
        F.lit("</span>"),
        _div(
            "qtext",
            F.lit("<p> "),
            F.col("p_name"),
            F.lit(" </p><table><tr><td>tabla</td></tr></table> <b>"),
            F.col("p_type"),
            F.lit('</b><br><img src="/img/'),
            F.col("key"),
            F.lit('.png"><img src="">'),
        ),
        row("r0", "a", F.col("p_type"), False),
        row("r1", "b", F.col("p_name"), True),
        row("r0", "c", F.lit("otra &amp; m&aacute;s"), False),
        F.lit("")
        if marked
        else _div("rightanswer", F.lit("La respuesta correcta es: "), F.upper("p_name"), F.lit(".")),
        _div("generalfeedback", F.lit("<p>Ver</p> <i>"), F.col("p_brand"), F.lit("</i>")),
        F.lit("</div>"),
    )
    page = F.concat(F.lit("<html><body>"), item, F.lit("</body></html>"))
    listed = F.concat(
        F.lit('<table><tr><td class="line-number">1</td><td class="line-content">'),
        F.replace(F.replace(page, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit("</td></tr></table>"),
    )
    return _part_pages(spark, sf_dir).select(
        "folder", "stem", F.when(F.col("p_size") > 40, listed).otherwise(page).alias("html")
    )


def accordion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved accordion page per part; the option marked by colour is its type."""

    def entry(label, colour):
        style = f'<span style="background:{colour}">' if colour else "<span>"
        return F.concat(
            F.lit(f'<li>{style}<span class="mdl-radio__label">'), label, F.lit("</span></span></li>")
        )

    name, kind = F.col("p_name"), F.col("p_type")
    item = F.concat(
        F.lit('<div class="gray-card accordion-item"><button data-bs-target="#question_'),
        F.col("key"),
        F.lit('"><b>'),
        name,
        F.lit('?</b></button><h6 class="modal-title"> '),
        F.col("p_brand"),
        F.lit('</h6><div class="modal-body"><p>"Ver &quot;'),
        name,
        F.lit('&quot;"</p></div><ul class="global-list">'),
        entry(F.concat(F.lit("a) "), name, F.lit(" (incorrecta): porque no: nunca")), ""),
        F.lit("<li>sin etiqueta</li>"),
        entry(F.concat(kind, kind, F.lit(" (Correcta): por qué")), "#CFFCE4"),
        entry(F.concat(F.lit("d) "), name, F.lit(" "), name), "#FFFFFF"),
        F.lit('</ul><img src="/i/'),
        F.col("key"),
        F.lit('.jpg"></div>'),
    )
    plain = F.concat(F.lit("<html><body>"), item, F.lit("</body></html>"))
    listed = F.concat(
        F.lit('<table><tr><td class="line-content">'),
        F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit("</td></tr></table>"),
    )
    return _part_pages(spark, sf_dir).select(
        "folder", "stem", F.when(F.col("p_size") > 40, listed).otherwise(plain).alias("html")
    )


def flat_question(questions: DataFrame, *more: str) -> DataFrame:
    """A question with its options as one string, for comparison by value."""
    options = F.transform(
        "answer_options",
        lambda o: F.concat_ws(
            "|", o["letter"], o["text"], o["explanation"], o["is_correct"].cast("string")
        ),
    )
    return questions.select(
        "question_id",
        "question_number",
        "topic",
        "question_text",
        F.concat_ws(";", options).alias("answer_options"),
        "correct_answer",
        "explanation",
        F.concat_ws(" ", "images").alias("images"),
        *more,
    )


def stored_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir).select(
        "question_id",
        "topic",
        "question_text",
        at(STORED_AT).alias("created_at"),
        at(STORED_AT).alias("updated_at"),
    )


def typed_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as stored questions with every column of the table."""
    labels = table(spark, sf_dir, "labels")
    known = {
        "question_id": F.col("doc_id").cast("string"),
        "topic": F.concat(F.lit("h"), F.col("quality").cast("string")),
        "created_at": at(STORED_AT),
        "updated_at": at(STORED_AT),
    }
    return labels.select(
        *[
            known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in S.QUESTIONS.fields
        ]
    )


def changed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents get a new topic; benchmark items come in as new questions.

    Toxic documents appear twice: the later row has to win.
    """
    labels = table(spark, sf_dir, "labels")
    once = labels.select(
        F.col("doc_id").alias("question_id"),
        F.lit("first").alias("topic"),
        F.lit("changed").alias("question_text"),
        F.lit(0).alias("ordinal"),
    )
    again = labels.where("toxic = 1").select(
        F.col("doc_id").alias("question_id"),
        F.lit("second").alias("topic"),
        F.lit("changed").alias("question_text"),
        F.lit(1).alias("ordinal"),
    )
    new = table(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("question_id"),
        F.lit("new").alias("topic"),
        F.col("text").alias("question_text"),
        F.lit(0).alias("ordinal"),
    )
    return once.unionByName(again).unionByName(new)
