"""A job in slices with a ledger: what is finished stays, a rerun does the rest.

The input is cut into slices by a hash of its key. A group of slices is worked
on at a time; its result is staged where no reader looks, counted, and then
published together with its entries in the ledger by the single rename of a
``CellTable``. So a job that is lost half-way has published whole groups with
their entries, and a rerun takes only slices that are new, whose input has
changed, or that failed.

A group whose work fails is halved until the failing slices stand alone; they
are noted with their error, the others are published. Result rows with
findings are kept apart from the accepted ones and counted.
"""

import uuid
from collections.abc import Callable, Iterable
from dataclasses import astuple, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.operators.quality import CheckFailed
from recallgrid.sources.cell_table import CELL, CellTable
from recallgrid.sources.storage import new_path
from recallgrid.streaming.state_table import Manifest

#: Slices of a job; the ledger has one entry for each.
SLICES = 256
_SLICE = "slice"
_LEDGER = "ledger"
_ENTRY = "slice int, digest string, n_in bigint, n_accepted bigint, n_rejected bigint, error string"
_ERROR_CHARS = 500


@dataclass
class Entry:
    slice: int
    #: Of the input the slice was last tried with, whatever the order of its rows.
    digest: str
    n_in: int
    n_accepted: int = 0
    n_rejected: int = 0
    error: str | None = None


class ResumableTable(CellTable):
    """The results in a folder that all executors can reach.

    ``schema`` is that of the result rows, which carry the ``key`` columns of
    the input unchanged. Key columns may be null; rows of one key share a slice,
    and a slice is a unit of publishing, not of work: Spark cuts it over tasks.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], slices: int = SLICES):
        super().__init__(spark, path, schema)
        self.key, self.slices = key, slices

    # --- Reading -----------------------------------------------------------------

    def cells(self, manifest: Manifest | None = None) -> dict[str, list[str]]:
        return {c: folders for c, folders in super().cells(manifest).items() if not c.startswith(_LEDGER)}

    def _side(self, rejected: bool, manifest: Manifest | None) -> DataFrame:
        now = manifest or self.manifest()
        return self.rows(now, [c for c in self.cells(now) if c.endswith(f"-{int(rejected)}")])

    def accepted(self, manifest: Manifest | None = None) -> DataFrame:
        """Published rows without findings."""
        return self._side(False, manifest)

    def quarantine(self, manifest: Manifest | None = None) -> DataFrame:
        """Published rows with findings."""
        return self._side(True, manifest)

    def ledger(self, manifest: Manifest | None = None) -> DataFrame:
        """One row per slice that was tried: input digest, counts, and the error if its last try failed."""
        names = [p for p in (manifest or self.manifest()).parts if p.startswith(_LEDGER)]
        return self.part(names[0]) if names else self.spark.createDataFrame([], _ENTRY)

    # --- Running -----------------------------------------------------------------

    def run(
        self,
        rows: DataFrame,
        work: Callable[[DataFrame], DataFrame],
        rejected: Column | None = None,
        at_once: int = 16,
        most_groups: int | None = None,
    ) -> DataFrame:
        """Bring the table up to date with the input and return the ledger.

        ``work`` makes one result row of each input row, without regard to
        other slices; ``rejected`` marks result rows with findings. At most
        ``most_groups`` groups of ``at_once`` slices are done in this call. The
        counts before and after the work must agree, otherwise the slice counts
        as failed; published rows of a slice stay until a later try succeeds.
        Slices that the input no longer has are removed. Input columns of type
        map or variant cannot be hashed; errors in the plan itself stop the job.
        """
        now = self.manifest()
        entries = {e["slice"]: Entry(**e.asDict()) for e in self.ledger(now).collect()}
        found = self._digests(rows)
        due = sorted(s for s, f in found.items() if s not in entries or entries[s].digest != f.digest or entries[s].error)
        gone = entries.keys() - found.keys()
        if gone:
            for s in gone:
                del entries[s]
            now = self._publish(now, entries, [], gone)
        groups = [due[i : i + at_once] for i in range(0, len(due), at_once)][:most_groups]
        if groups:
            dealt = self._dealt(rows, [s for g in groups for s in g])
        for group in groups:
            parts, done = self._attempt(dealt, group, work, rejected, found)
            entries |= done
            now = self._publish(now, entries, parts, {s for s, e in done.items() if not e.error})
        return self.ledger(now)

    def _slice(self) -> Column:
        typed = [F.col(f"`{c}`").cast(self.schema[c].dataType) for c in self.key]
        return F.pmod(F.xxhash64(*typed), F.lit(self.slices)).cast("int")

    def _digests(self, rows: DataFrame) -> dict[int, Entry]:
        """Count and digest per slice, in one pass with partial aggregation."""
        columns = [F.col(f"`{c}`") for c in rows.columns]
        # Nulls leave a hash as it is, so where they are is hashed as well.
        hashed = rows.select(self._slice().alias(_SLICE), F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("h"))
        digests = hashed.groupBy(_SLICE).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("h").cast("decimal(20,0)")).alias("total"),
            F.sum(F.xxhash64("h").cast("decimal(20,0)")).alias("again"),
        )
        return {r[_SLICE]: Entry(r[_SLICE], f"{r['n']}:{r['total']}:{r['again']}", r["n"]) for r in digests.collect()}

    def _dealt(self, rows: DataFrame, slices: list[int]) -> DataFrame:
        """The due input by slice, so that each group reads its own files only."""
        placed = rows.select("*", self._slice().alias(f"_{_SLICE}"))
        path = new_path(self.spark, "slices")
        due = placed.where(F.col(f"_{_SLICE}").isin(slices)).hint("rebalance", f"_{_SLICE}")
        due.write.partitionBy(f"_{_SLICE}").parquet(path)
        return self.spark.read.schema(placed.schema).parquet(path)

    def _attempt(
        self, dealt: DataFrame, slices: list[int], work, rejected: Column | None, found: dict[int, Entry]
    ) -> tuple[list[str], dict[int, Entry]]:
        """Staged folders and ledger entries of the slices."""
        mine = dealt.where(F.col(f"_{_SLICE}").isin(slices)).drop(f"_{_SLICE}")
        try:
            return self._staged(work(mine), rejected, {s: found[s] for s in slices})
        except AnalysisException:
            raise
        except (PySparkException, Py4JJavaError, CheckFailed) as error:
            if len(slices) == 1:
                entry = found[slices[0]]
                return [], {entry.slice: Entry(entry.slice, entry.digest, entry.n_in, error=str(error)[:_ERROR_CHARS])}
        half = len(slices) // 2
        sides = [self._attempt(dealt, part, work, rejected, found) for part in (slices[:half], slices[half:])]
        return sides[0][0] + sides[1][0], sides[0][1] | sides[1][1]

    def _staged(self, result: DataFrame, rejected: Column | None, wanted: dict[int, Entry]) -> tuple[list[str], dict[int, Entry]]:
        """Write the result beside the table and count what is in the files, not what a task says it wrote."""
        side = F.coalesce(F.lit(False) if rejected is None else rejected, F.lit(False)).cast("int")
        parts = self.write_cells(result, F.concat_ws("-", self._slice(), side))
        entries = {s: Entry(s, w.digest, w.n_in) for s, w in wanted.items()}
        counts = []
        if parts:
            typed = T.StructType([*self.schema.fields, T.StructField(CELL, T.StringType())])
            written = self.spark.read.schema(typed).parquet(f"{self.path}/parts/{parts[0].partition('/')[0]}")
            counts = written.groupBy(CELL).agg(F.count(F.lit(1)).alias("n")).collect()
        for cell, n in counts:
            s, _, flag = cell.partition("-")
            if int(s) not in entries:
                raise CheckFailed(f"the work made rows of slice {s}, which it was not given")
            entry = entries[int(s)]
            entry.n_rejected, entry.n_accepted = (n, entry.n_accepted) if flag == "1" else (entry.n_rejected, n)
        for s, e in entries.items():
            if e.n_accepted + e.n_rejected != e.n_in:
                raise CheckFailed(f"slice {s}: {e.n_in} rows in, {e.n_accepted} accepted and {e.n_rejected} rejected")
        return parts, entries

    def _publish(self, now: Manifest, entries: dict[int, Entry], parts: list[str], replaced: Iterable[int]) -> Manifest:
        """The parts take the place of the slices' cells; their entries appear with them."""
        replaced = {str(s) for s in replaced}
        kept = [f for c, folders in self.cells(now).items() if c.partition("-")[0] not in replaced for f in folders]
        name = f"{_LEDGER}-{uuid.uuid4().hex}"
        rows = self.spark.createDataFrame([astuple(e) for e in entries.values()], _ENTRY)
        rows.coalesce(1).write.parquet(f"{self.path}/parts/{name}")
        return self.commit(now, now.batch + 1, None, [name, *kept, *parts])
