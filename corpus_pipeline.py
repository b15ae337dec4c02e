"""A training corpus in five stages: language, near-duplicates, personal data, mix, pieces.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; run() applies them to the table documents, storing each
stage's rows before the next. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import language, mixing, pieces, pii, simhash
from recallgrid.llm.common import table
from recallgrid.sources.storage import stored


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose doc_id and text (text_hash) are not among the rejected ones; a null doc_id is one like any other."""
    keys = stored(rejected.select("doc_id", "text_hash").distinct(), "rejected").alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.text_hash"))
    return docs.alias("d").join(keys, same, "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; texts without letters or in none of the corpus's languages go.

    Null and empty texts have no letters. Rows are judged one by one, with
    repeated or null doc_ids too; repeated rows share their fate. A very long
    text is read in pieces. Empty table: no rows.
    """
    evidence = language.page_evidence(table(spark, sf_dir, "pages"))
    return _without(docs, language.identify(docs, evidence).filter("not kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays (three words, two bits).

    It is the one with the smallest doc_id, null last, then the smallest hash
    of the text; of rows that repeat both, one. Null, empty and wordless texts
    are one group. Empty table: no rows.
    """
    groups = stored(simhash.grouped(docs).select("group", "doc_id", "text_hash"), "groups")
    rows = groups.groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n")).alias("first"))
    first = stored(first, "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    left = _without(docs, groups.join(first, "group").filter(~kept))
    again = first.filter("first.n > 1").select("first.doc_id", "first.text_hash")
    if again.isEmpty():
        return left
    # Rows that repeat both are rare; only these are compared with one another.
    again = stored(again, "again").alias("r")
    placed = left.select(F.struct(*left.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("r.doc_id")) & (F.col("hash") == F.col("r.text_hash"))
    once = placed.join(again, same, "left_anti")
    repeated = placed.join(again, same, "left_semi").dropDuplicates(["id", "hash"])
    return once.unionByName(repeated).select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows the text.

    A null text stays null. Every row is a document of its own; empty table: no rows.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as many rows of each as it uses them.

    Null, empty and wordless texts are not taken. Rows that repeat doc_id and
    text count one by one, and are taken alike on a border. Empty table: no rows.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of each text and its alternatives.

    Null or empty text: no ids. Every row is a document of its own; empty table: no rows.
    """
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The stages hold models and graph steps that SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
