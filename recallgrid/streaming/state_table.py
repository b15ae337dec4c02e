"""A table of parts with a manifest: small changes are added, now and then all are merged.

A version of the table is one manifest, a small JSON file that names the parts
it is made of and the last micro-batch in it. Parts are never changed. A new
version is written beside the old one and appears by a single rename, so a
reader has either the one or the other, also when the writer is lost between
two steps; what it left without a manifest is removed by the next commit. Old
versions stay for a while, for readers that still hold them.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Versions whose parts are still there, the newest included.
RETAINED = 3


@dataclass
class Manifest:
    version: int = -1
    #: Last micro-batch whose rows are in the parts, and the stream that it belongs to.
    batch: int = -1
    stream: str | None = None
    parts: list[str] = field(default_factory=list)


class StateTable:
    """The table in a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._paths(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._files.listStatus(place)] if self._files.exists(place) else []

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("."))

    def _place(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _read(self, version: int) -> Manifest:
        source = self._files.open(self._paths(self._place(version)))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
        finally:
            source.close()

    def manifest(self) -> Manifest:
        """The newest version; an empty one before the first."""
        versions = self._versions()
        return self._read(versions[-1]) if versions else Manifest()

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/parts/{name}")

    def rows(self, manifest: Manifest | None = None) -> DataFrame:
        """All rows of a version, by default the newest."""
        parts = (manifest or self.manifest()).parts
        if not parts:
            raise FileNotFoundError(f"{self.path} has no version yet")
        return self.spark.read.parquet(*(f"{self.path}/parts/{p}" for p in parts))

    def write(self, rows: DataFrame, kind: str) -> str:
        """A new part that no version names yet."""
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/parts/{name}")
        return name

    def commit(self, before: Manifest, batch: int, stream: str | None, parts: list[str]) -> Manifest:
        """Make a version of the parts; fails if another writer has made one meanwhile."""
        new = Manifest(before.version + 1, batch, stream, parts)
        hidden = self._paths(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._files.create(hidden, False)
        out.write(bytearray(json.dumps(asdict(new)), "utf-8"))
        out.close()
        if self._files.exists(self._paths(self._place(new.version))) or not self._files.rename(hidden, self._paths(self._place(new.version))):
            self._files.delete(hidden, False)
            raise RuntimeError(f"{self.path} got version {new.version} from another writer")
        self._tidy(set(parts))
        return new

    def _tidy(self, named: set[str]) -> None:
        """Remove versions beyond RETAINED, and parts that no version names."""
        versions, gone = self._versions(), set()
        for version in versions[-RETAINED:]:
            named = named | set(self._read(version).parts)
        for version in versions[:-RETAINED]:
            gone |= set(self._read(version).parts)
        kept = {name.split("/")[0] for name in named}
        for name in (gone - named) | (set(self._names("parts")) - kept):
            self._files.delete(self._paths(f"{self.path}/parts/{name}"), True)
        # The names go last: a writer lost before leaves nothing that the next one would not find.
        for version in versions[:-RETAINED]:
            self._files.delete(self._paths(self._place(version)), False)

    def add(self, rows: DataFrame, batch: int, stream: str, most: int, merge: Callable[[DataFrame], DataFrame]) -> Manifest:
        """The rows of a micro-batch as a further part, each batch once.

        When more than ``most`` parts lie beside the merged one, all become
        one by ``merge``. A batch that is in the table already (its commit was
        not noted before a crash) changes nothing.
        """
        now = self.manifest()
        if now.stream not in (None, stream):
            raise ValueError(f"{self.path} is kept by another stream ({now.stream})")
        if batch <= now.batch:
            return now
        parts = [*now.parts, self.write(rows, f"batch-{batch:012d}")]
        if len(parts) > most + 1:
            merged = merge(self.rows(Manifest(parts=parts)))
            parts = [self.write(merged, f"merged-{batch:012d}")]
        return self.commit(now, batch, stream, parts)
