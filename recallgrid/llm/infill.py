"""Fill-in-the-middle: texts cut at token borders and rearranged around marks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import batch_of, bounded_batches, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a block of text; the tree has one leaf for each.
BLOCK = 4096
#: Blocks that are counted at once.
_AT_ONCE = 256
#: Of 100 texts, so many are rearranged, and of 100 of these so many put the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20


def unit_starts(data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes low to high of a UTF-8 text: which start a unit, which a code point.

    A unit is a run of ASCII letters or one other code point.
    """
    part = data[low:high]
    letter = ((part | 32) - 97).astype(np.uint8) < 26
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[0] = low > 0 and (int(data[low - 1]) | 32) - 97 in range(26)
    point = (part & 0xC0) != 0x80
    return point & ~(letter & before), point


class BlockTree:
    """Fenwick tree over the fixed blocks of a text: sums of their units and code points."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.blocks = -(-len(data) // BLOCK)
        counts = np.zeros((2, self.blocks), np.int64)
        for first in range(0, self.blocks, _AT_ONCE):
            low, last = first * BLOCK, min(first + _AT_ONCE, self.blocks)
            marks = unit_starts(self.data, low, min(last * BLOCK, len(data)))
            for row, mark in zip(counts, marks, strict=True):
                row[first:last] = np.add.reduceat(mark, np.arange(0, len(mark), BLOCK), dtype=np.int64)
        sums = np.concatenate([np.zeros((2, 1), np.int64), counts.cumsum(1)], axis=1)
        self.units, self.points = sums[:, -1].tolist()
        at = np.arange(self.blocks + 1)
        # A node holds the blocks behind the one at its place without its lowest bit.
        self.nodes = (sums - sums[:, at & (at - 1)]).T.tolist()

    def border(self, unit: int) -> tuple[int, int]:
        """Byte and code point at which a unit starts, counted from 0; the end of the text behind the last."""
        if unit >= self.units:
            return len(self.data), self.points
        block, points, step = 0, 0, 1 << self.blocks.bit_length()
        while step := step >> 1:
            if block + step <= self.blocks and self.nodes[block + step][0] <= unit:
                block += step
                unit -= self.nodes[block][0]
                points += self.nodes[block][1]
        low = block * BLOCK
        starts, point = unit_starts(self.data, low, min(low + BLOCK, len(self.data)))
        at = int(np.flatnonzero(starts)[unit])
        return low + at, points + int(np.count_nonzero(point[:at]))


def draws(doc_id: int | None, epoch: int) -> list[int]:
    """h1 to h4 of a document; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{epoch}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(doc_id: int | None, data: bytes, epoch: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (None if plain), and the output of one text."""
    tree = BlockTree(data)
    h1, h2, h3, h4 = draws(doc_id, epoch)
    if not data or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= REARRANGED:
        return tree.units, "plain", None, None, data
    first, second = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    (a, a_points), (b, b_points) = tree.border(first), tree.border(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < SUFFIX_FIRST:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return tree.units, form, a_points, b_points - a_points, b"".join(parts)


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
        ("output", pa.binary()),
    ]
)


def _arrange(epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from recallgrid.llm import infill

        for batch in batches:
            rows = [infill.arranged(d, x, epoch) for d, x in zip(batch.column(0).to_pylist(), texts(batch), strict=True)]
            if rows:
                yield batch_of(infill._SCHEMA, [batch.column(0), *zip(*rows, strict=True)])

    return run


def rearranged(docs: DataFrame, epoch: int = 1) -> DataFrame:
    """Each document cut in prefix, middle and suffix and put together for fill-in-the-middle training.

    docs: doc_id long, text string; other columns are not read. Returns
    doc_id, n (units of the text), form, prefix_chars and middle_chars (code
    points), output. Borders, form and order follow from the sha256 of
    `epoch:doc_id`, so a rerun gives the same and another epoch other cuts.
    The blocks of a text are leaves of a Fenwick tree with the numbers of
    their units and code points; binary lifting finds the block of a border,
    and only that block is looked at again.

    Null or empty text: form plain, n 0, an empty output. Texts that hold a
    mark are plain and come back unchanged. A very long text costs memory in
    proportion to it, once. Null doc_id: drawn by the hash of an empty id.
    Repeated rows: one row each, all alike. Empty table: no rows.
    """
    bounded_batches(docs.sparkSession)
    columns = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    rows = docs.select("doc_id", "text").mapInArrow(_arrange(epoch), columns)
    return rows.withColumn("output", F.col("output").cast("string"))


def restored(rows: DataFrame) -> DataFrame:
    """The rows with `text`, put together again from output and form.

    A plain output is the text. Other texts hold no mark, and no mark can
    arise across a border, so the first marks are the ones put in. Null
    output or form: null.
    """
    mark = lambda x: F.lit(x.decode())
    middle = F.split_part("output", mark(MIDDLE), F.lit(2))
    before = F.split_part("output", mark(MIDDLE), F.lit(1))
    in_order = F.split_part(F.split_part(before, mark(PREFIX), F.lit(2)), mark(SUFFIX), F.lit(1))
    suffix = F.split_part(F.split_part(before, mark(SUFFIX), F.lit(2)), mark(PREFIX), F.lit(1))
    # In either order, the part behind a mark ends at the next one.
    text = F.when(F.col("form") == "plain", F.col("output")).when(
        F.col("form").isin("psm", "spm"), F.concat(in_order, middle, suffix)
    )
    return rows.withColumn("text", text)


def digests(docs: DataFrame) -> DataFrame:
    """The rearranged documents with sha256 of the output and of the text restored from it, instead of both."""
    rows = restored(rearranged(docs))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("text", 256).alias("restored_sha256"),
    )


#: DuckDB: the same rows as digests over documents.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS u1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS u2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS u3,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS u4
  FROM cut
), parts AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR u3 >= 90 THEN 'plain'
      WHEN u4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(units[1:least(u1, u2)], ''), '') AS p,
    coalesce(array_to_string(units[least(u1, u2) + 1:greatest(u1, u2)], ''), '') AS m,
    coalesce(array_to_string(units[greatest(u1, u2) + 1:n], ''), '') AS s
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
