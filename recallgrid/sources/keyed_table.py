"""A stored table with a key whose changes rewrite hash buckets, not the table.

The rows lie in buckets by a hash of some of their columns. A change names its
keys, these name their buckets, and only those are read, run through the
operators of ``recallgrid.operators.maintenance`` and written again; all of
them appear in one step (``CellTable``). Choose the bucket columns so that what
an operator compares lies in one bucket: the learner for cards, whose front
texts are unique by learner, the id for questions.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.operators import maintenance
from recallgrid.sources.cell_table import CellTable, joined_on

#: Buckets of a table; the names of touched ones (at most this many) reach the driver.
BUCKETS = 256


class KeyedTable:
    """``by`` names the bucket columns; the number of buckets is fixed with the first rows."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: list[str], buckets: int = BUCKETS):
        self.by, self.buckets = by, buckets
        self.cells = CellTable(spark, path, schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("string")

    def rows(self) -> DataFrame:
        return self.cells.rows()

    def _touched(self, keys: DataFrame) -> list[str]:
        typed = keys.select(*[F.col(c).cast(self.cells.schema[c].dataType).alias(c) for c in self.by])
        return [r[0] for r in typed.select(self._bucket()).distinct().collect()]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows whose bucket columns are among the keys; only their buckets are read."""
        return joined_on(self.cells.rows(cells=self._touched(keys)), keys, self.by, "left_semi")

    def load(self, rows: DataFrame) -> None:
        """The first content."""
        if self.cells.manifest().version >= 0:
            raise ValueError(f"{self.cells.path} has content already")
        self.cells.append(rows, self._bucket(), 0, None)

    def change(self, keys: DataFrame, new: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Replace the buckets of the keys by what ``new`` makes of their rows; returns their names.

        Without keys nothing is written. A writer lost before the last step
        has changed nothing, so a change that failed can be made again.
        """
        touched = self._touched(keys)
        if touched:
            now = self.cells.manifest()
            content = new(self.cells.rows(now, touched))
            self.cells.replace(content, self._bucket(), touched, now.batch + 1, None)
        return touched

    def upsert(self, changes: DataFrame, now: Column, order: str | None = None) -> list[str]:
        """See maintenance.upsert; the one bucket column is the key."""
        (key,) = self.by
        return self.change(changes, lambda rows: maintenance.upsert(rows, changes, now, key, order))

    def insert_new(self, incoming: DataFrame, keys: list[str], order: list[str]) -> list[str]:
        """See maintenance.insert_new; ``keys`` include the bucket columns."""

        def grown(rows: DataFrame) -> DataFrame:
            marked = maintenance.insert_new(rows, incoming, keys, order)
            return rows.unionByName(maintenance.rows_to_append(marked).select(*rows.columns))

        return self.change(incoming, grown)

    def update_cards(self, changes: DataFrame, key: list[str]) -> list[str]:
        """See maintenance.update_cards; the bucket column is the learner."""
        return self.change(changes, lambda rows: maintenance.update_cards(rows, changes, key))

    def archive_cards(self, ids: DataFrame, key: list[str]) -> list[str]:
        return self.change(ids, lambda rows: maintenance.archive_cards(rows, ids, key))

    def remove(self, keys: DataFrame) -> list[str]:
        """All rows of the keys go; the bucket columns are the key (a learner, say)."""
        return self.change(keys, lambda rows: joined_on(rows, keys, self.by, "left_anti"))
