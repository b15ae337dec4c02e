"""Shared helpers: table access, bounded Arrow batches, words of a text."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch that Spark hands to Python.
BATCH_BYTES = 4 << 20

#: Words are runs without these characters; bytes.split() cuts at the same ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; a null text is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(data: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """Cut a long text at white space into pieces of about `limit` bytes.

    No word is cut: a word longer than the limit stays whole.
    """
    at, size = 0, len(data)
    while size - at > limit:
        end = at + limit
        while end < size and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def slices(batches: Iterable[pa.RecordBatch], limit: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose texts hold about `limit` bytes; a longer text is a slice of its own."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pc.binary_length(batch.column(batch.schema.get_field_index(name))).to_pylist()):
            if held and held + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < len(batch):
            yield batch.slice(start)


def give_back() -> None:
    """Memory that a task no longer needs goes back to the system, as its worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # Only glibc has it.


class Remembered(dict):
    """A bounded memo: value by key, emptied when it holds too many keys."""

    def __init__(self, of, most: int = 600_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.of(key)
        return value


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
