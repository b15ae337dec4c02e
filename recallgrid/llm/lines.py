"""Repeated lines and sentences: the earliest occurrence of a unit stays."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import batch_of, bounded_batches, texts
from recallgrid.sources.storage import stored

#: A line is cut behind sentence ends; shorter sentences join the next one of their line.
UNIT_WORDS = 5
#: Least words of a returned span: none is left out, however short. Callers may filter by n_words.
RUN_WORDS = 0

_SENTENCE_END = re.compile(r"[.!?][\"')\]]*[^\S\n]+")
_DROPPED = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def normal(text: str) -> list[str]:
    """Words of a unit in lower case and without ASCII punctuation."""
    return text.lower().translate(_DROPPED).split()


def units(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text, in code points; units without a word are left out."""
    line_at = 0
    for line in text.split("\n"):
        start, held = 0, []
        ends = [m.end() for m in _SENTENCE_END.finditer(line)]
        if not ends or ends[-1] < len(line):
            ends.append(len(line))
        at = 0
        for i, end in enumerate(ends):
            held += normal(line[at:end])
            at = end
            if held and (len(held) >= UNIT_WORDS or i == len(ends) - 1):
                yield line_at + start, line_at + end, len(held), xxhash.xxh3_128_digest(" ".join(held).encode("utf-8", "replace"))
                start, held = end, []
        line_at += len(line) + 1


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "doc_id", "unit", "start", "end", "n_words", "key_1", "key_2"]
    schema = pa.schema([(n, pa.int32() if n in names[2:6] else pa.int64()) for n in names])
    for batch in batches:
        rows = []
        for row, doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), strict=True):
            for i, (start, end, words, digest) in enumerate(units(data.decode("utf-8", "replace"))):
                rows.append((row, doc, i, start, end, words, *struct.unpack("<qq", digest)))
            if len(rows) >= 50_000:
                yield batch_of(schema, zip(*rows, strict=True))
                rows = []
        if rows:
            yield batch_of(schema, zip(*rows, strict=True))


def repeated_units(docs: DataFrame) -> DataFrame:
    """Spans of each document to remove: row, doc_id, start, end, n_units, n_words, keeper_doc_id.

    docs: doc_id long, text string; other columns are not read. Texts are cut
    into lines, and lines behind sentence ends; each unit is normalised (lower
    case, no ASCII punctuation, single spaces) and hashed to 128 bits. Digests
    are grouped over all documents with partial aggregates, and the occurrence
    that is first by (doc_id, row, position) stays. All others are removed;
    those that stand together in a document are one span, of n_units units and
    n_words words. Words are split at white space, so n_words says little of
    texts without it; a caller's least length should spare whole lines and
    whole texts. Offsets are code points of the original text, end exclusive. A frequent unit is never gathered:
    its occurrences only meet the one row that names the keeper, in a join
    that adaptive execution may split.

    Null or empty text: no units. A null doc_id comes last. Repeated rows are
    documents of their own (told apart by row), so the later is removed.
    Empty table: no rows.
    """
    bounded_batches(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = numbered.mapInArrow(
        _units, "row long, doc_id long, unit int, start int, end int, n_words int, key_1 long, key_2 long"
    )
    cut = stored(cut, "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "unit")
    # Stored, so that the join deals both of its sides anew and a frequent unit can be split.
    kept = stored(
        cut.groupBy("key_1", "key_2")
        .agg(F.min(place).alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n"),
        "keepers",
    )
    again = cut.join(kept, ["key_1", "key_2"]).filter(
        (F.col("row") != F.col("keeper.row")) | (F.col("unit") != F.col("keeper.unit"))
    )
    in_text = Window.partitionBy("row").orderBy("unit")
    together = again.withColumn("run", F.col("unit") - F.row_number().over(in_text))
    return (
        together.groupBy("row", "run")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("start").cast("long").alias("start"),
            F.max("end").cast("long").alias("end"),
            F.count(F.lit(1)).alias("n_units"),
            F.sum("n_words").alias("n_words"),
            F.min_by("keeper.doc_id", "unit").alias("keeper_doc_id"),
        )
        .select("row", "doc_id", "start", "end", "n_units", "n_words", "keeper_doc_id")
    )
