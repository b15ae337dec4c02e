"""A table in cells: a change rewrites the cells it touches and appears in one step.

A ``StateTable`` whose parts are folders of one cell each. A version names for
every cell the folders that make it up, so replacing a few cells writes these
few, the others stay the files they are, and a reader has all of a change or
nothing of it. What a cell is (a hash bucket of the key, a span of days) is the
caller's choice; it is a short text of digits and hyphens.
"""

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.streaming.state_table import Manifest, StateTable

CELL = "cell"


def joined_on(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Rows of the left side that have (left_semi) or lack (left_anti) a partner; a null key is one like any other."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return left.alias("l").join(right.select(*columns).alias("r"), same, how)


class CellTable(StateTable):
    """The table in a folder that all executors can reach; ``schema`` is that of its rows, without the cell."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        super().__init__(spark, path)
        self.schema = schema

    def cells(self, manifest: Manifest | None = None) -> dict[str, list[str]]:
        """The folders of each cell in a version, by default the newest."""
        folders: dict[str, list[str]] = {}
        for part in (manifest or self.manifest()).parts:
            folders.setdefault(part.rpartition(f"{CELL}=")[2], []).append(part)
        return folders

    def rows(self, manifest: Manifest | None = None, cells: Iterable[str] | None = None) -> DataFrame:
        """Rows of a version; of the named cells only their files are read. None before the first version."""
        folders = self.cells(manifest)
        named = folders if cells is None else sorted(set(cells) & folders.keys())
        paths = [f"{self.path}/parts/{f}" for c in named for f in folders[c]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write_cells(self, rows: DataFrame, cell: Column) -> list[str]:
        """The rows as folders of their cells that no version names yet.

        Rows meet by cell, so a cell has few files; adaptive execution cuts a
        large cell over several tasks and lets small ones share one.
        """
        name = f"cells-{uuid.uuid4().hex}"
        placed = rows.select(*[f.name for f in self.schema], cell.cast("string").alias(CELL))
        placed.hint("rebalance", CELL).write.partitionBy(CELL).parquet(f"{self.path}/parts/{name}")
        return [f"{name}/{n}" for n in self._names(f"parts/{name}") if n.startswith(f"{CELL}=")]

    def append(self, rows: DataFrame, cell: Column, batch: int, stream: str | None) -> Manifest:
        """Further rows of their cells; what is there stays. A batch that is in the table changes nothing."""
        now = self._next(batch, stream)
        if now.batch >= batch:
            return now
        return self.commit(now, batch, stream, [*now.parts, *self.write_cells(rows, cell)])

    def replace(self, rows: DataFrame, cell: Column, touched: Iterable[str], batch: int, stream: str | None) -> Manifest:
        """The rows are the new content of the touched cells. A batch that is in the table changes nothing."""
        now = self._next(batch, stream)
        if now.batch >= batch:
            return now
        touched, written = set(touched), self.write_cells(rows, cell)
        strange = {f.rpartition(f"{CELL}=")[2] for f in written} - touched
        if strange:
            raise ValueError(f"rows of cells that are not replaced: {sorted(strange)[:5]}")
        kept = [f for c, folders in self.cells(now).items() if c not in touched for f in folders]
        return self.commit(now, batch, stream, [*kept, *written])

    def _next(self, batch: int, stream: str | None) -> Manifest:
        now = self.manifest()
        if now.stream not in (None, stream):
            raise ValueError(f"{self.path} is kept by another stream ({now.stream})")
        return now
