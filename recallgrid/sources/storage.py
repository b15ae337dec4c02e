"""Shared working folder for checkpoints and rewritten tables."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_PATHS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a session whose tasks run in the driver's own process (tests, a first
    try) may do without the setting; it gets a folder that goes when it ends.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{_SETTING} must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="recallgrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(_SETTING, folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder once and read back.

    For a result that several branches of a job need: it is computed once,
    survives the loss of executors, and its real size is known to the joins
    that follow, so Spark broadcasts it only when it is small. The files stay
    until the ``scratch`` around the job ends, or are left to the folder's owner.
    """
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what jobs inside it wrote to the shared folder.

    Write or collect results before it ends. Paths of other threads count too:
    one job at a time.
    """
    start = len(_PATHS)
    try:
        yield
    finally:
        for path in _PATHS[start:]:
            location = spark._jvm.org.apache.hadoop.fs.Path(path)
            location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
        del _PATHS[start:]
