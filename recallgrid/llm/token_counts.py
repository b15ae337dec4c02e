"""Token counts of whole texts without keeping the tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from recallgrid.llm.common import batch_of, bounded_batches, pieces, texts

#: Distinct segments a worker remembers, and bytes it hands to the library at once.
REMEMBERED = 600_000
ENCODE_BYTES = 1 << 18
#: A longer segment is encoded on its own and not remembered.
LONG_SEGMENT = 256

_HELD: dict[str, SegmentCounts] = {}


class SegmentCounts(dict):
    """Number of tokens by segment, as the tokenizer file's library gives them."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def learn(self, segments) -> None:
        """Encode the segments in batches of about ENCODE_BYTES."""
        batch, held = [], 0
        for segment in segments:
            batch.append(segment)
            held += len(segment)
            if held >= ENCODE_BYTES:
                self._encode(batch)
                batch, held = [], 0
        self._encode(batch)

    def _encode(self, batch: list[bytes]) -> None:
        if batch:
            done = self.tokenizer.encode_batch_fast(
                [x.decode("utf-8", "replace") for x in batch], add_special_tokens=False
            )
            self.update(zip(batch, map(len, done), strict=True))

    def total(self, data: bytes) -> int:
        n = 0
        for piece in pieces(data):
            words = piece.split()
            new = [w for w in set(words) if w not in self]
            if new:
                if len(self) + len(new) > REMEMBERED:
                    self.clear()
                    new = list(set(words))
                self.learn(new)
            n += sum(map(self.__getitem__, words))
            for word in new:
                if len(word) > LONG_SEGMENT:
                    del self[word]
        return n


def held(path: str) -> SegmentCounts:
    """The counts of this Python worker, kept from task to task."""
    if path not in _HELD:
        _HELD[path] = SegmentCounts(path)
    return _HELD[path]


def _counts(path: str, limit: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Imported here, as the functions that Spark sends carry copies of their globals.
        from recallgrid.llm import token_counts

        counts = token_counts.held(path)
        for batch in batches:
            data = texts(batch)
            n = [counts.total(x) for x in data]
            yield batch_of(schema, [batch.column(0), [len(x) for x in data], n, [x > limit for x in n]])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Number of tokens of each document's whole text.

    docs: doc_id long, text string; other columns are not read. The tokenizer
    must drop white space before it splits into words, so that no token and no
    merge crosses white space: a text is cut there into segments, distinct
    segments are encoded in batches balanced by bytes, and only their lengths
    are kept. Special strings inside a text count as the library's default
    has it. Spark's file splits and BATCH_BYTES balance the work by bytes.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows: one row each. Null
    doc_id: kept as null. Empty table: no rows. tokenizer_path must exist on
    the executors.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _counts(tokenizer_path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
