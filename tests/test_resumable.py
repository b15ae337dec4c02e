"""Jobs in slices: stopped and resumed, changed input, failing slices, two-phase publishing."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.sources.resumable import ResumableTable

INPUT = "id string, text string"
RESULT = T.StructType().add("id", "string").add("n", "integer").add("odd", "boolean")


def lengths(frame):
    return frame.select("id", F.length("text").alias("n"), (F.length("text") % 2 == 1).alias("odd"))


def made(spark, n):
    return spark.createDataFrame([(str(i) if i % 10 else None, "x" * i if i % 7 else None) for i in range(n)], INPUT)


def table(spark, tmp_path, slices=8):
    return ResumableTable(spark, str(tmp_path / "job"), RESULT, ["id"], slices)


def rows(frame):
    return sorted(frame.collect(), key=repr)


class Stopped(Exception):
    """The driver is lost here."""


def test_a_stopped_job_does_the_rest_once(spark, tmp_path):
    job, source, tried = table(spark, tmp_path), made(spark, 60), []

    def work(frame, stop_at=None):
        tried.append({r[0] for r in frame.select(job._slice()).distinct().collect()})
        if len(tried) == stop_at:
            raise Stopped
        return lengths(frame)

    with pytest.raises(Stopped):
        job.run(source, lambda f: work(f, 3), at_once=2)
    published = rows(job.accepted())
    assert 0 < len(published) < 60 and job.ledger().count() == 4
    finished = tried[0] | tried[1]
    tried.clear()
    ledger = job.run(source, work, at_once=2).collect()
    assert not finished & set().union(*tried)
    assert rows(job.accepted()) == rows(lengths(source))
    assert sum(e.n_in for e in ledger) == sum(e.n_accepted for e in ledger) == 60
    tried.clear()
    job.run(source, work)
    assert not tried


def test_lost_between_staging_and_publishing(spark, tmp_path, monkeypatch):
    job, source = table(spark, tmp_path), made(spark, 30)
    job.run(source, lengths, at_once=4, most_groups=1)
    before, version = rows(job.accepted()), job.manifest()

    def lost(*_):
        raise Stopped

    monkeypatch.setattr(job, "commit", lost)
    with pytest.raises(Stopped):
        job.run(source, lengths, at_once=4)
    monkeypatch.undo()
    assert rows(job.accepted()) == before and job.manifest() == version
    job.run(source, lengths, at_once=4)
    assert rows(job.accepted()) == rows(lengths(source))
    # What the lost try had staged is gone with the next versions.
    named = {p.partition("/")[0] for v in job._versions() for p in job._read(v).parts}
    assert set(job._names("parts")) == named


def test_changed_input_is_done_again_and_gone_input_leaves(spark, tmp_path):
    job, source = table(spark, tmp_path), made(spark, 40)
    job.run(source, lengths)
    swapped = source.withColumn("text", F.when(F.col("id") == "11", "new").otherwise(F.col("text")))
    tried = []

    def work(frame):
        tried.append(frame.select(job._slice()).distinct().count())
        return lengths(frame)

    job.run(swapped.repartition(3), work)
    assert tried == [1] and rows(job.accepted()) == rows(lengths(swapped))
    few = swapped.where(F.col("id") == "11")
    job.run(few, work)
    assert rows(job.accepted()) == rows(lengths(few)) and job.ledger().count() == 1
    job.run(few.limit(0), work)
    assert job.accepted().count() == job.ledger().count() == 0


def test_nulls_that_change_places_are_a_change(spark, tmp_path):
    schema = T.StructType().add("id", "string").add("a", "string").add("b", "string")
    job = ResumableTable(spark, str(tmp_path / "job"), schema, ["id"], 4)
    job.run(spark.createDataFrame([("k", "v", None)], schema), lambda f: f)
    job.run(spark.createDataFrame([("k", None, "v")], schema), lambda f: f)
    assert [tuple(r) for r in job.accepted().collect()] == [("k", None, "v")]


def test_a_failing_slice_stands_alone(spark, tmp_path):
    job, source = table(spark, tmp_path, 16), made(spark, 60)
    bad = F.raise_error(F.lit("cannot be read")).cast("int")

    def work(frame):
        return lengths(frame).withColumn("n", F.when(F.col("id") == "13", bad).otherwise(F.col("n")))

    ledger = job.run(source, work, at_once=16).collect()
    failed = [e for e in ledger if e.error]
    assert len(failed) == 1 and "cannot be read" in failed[0].error and failed[0].n_accepted == 0
    assert job.accepted().count() == 60 - failed[0].n_in
    assert "13" not in {r.id for r in job.accepted().collect()}
    again = job.run(source, lengths).collect()
    assert not [e for e in again if e.error] and rows(job.accepted()) == rows(lengths(source))
    # A later failure leaves what is published.
    changed = source.withColumn("text", F.when(F.col("id") == "13", "z").otherwise(F.col("text")))
    assert [e.error for e in job.run(changed, work).collect() if e.error]
    assert rows(job.accepted()) == rows(lengths(source))


def test_findings_go_to_the_quarantine(spark, tmp_path):
    job, source = table(spark, tmp_path), made(spark, 50)
    ledger = job.run(source, lengths, F.col("odd"), at_once=3).collect()
    want = lengths(source)
    assert rows(job.quarantine()) == rows(want.where("odd"))
    assert rows(job.accepted()) == rows(want.where("not odd or odd is null"))
    assert sum(e.n_rejected for e in ledger) == job.quarantine().count()


def test_lost_rows_and_strange_rows_are_failures(spark, tmp_path):
    job, source = table(spark, tmp_path, 4), made(spark, 40)
    ledger = job.run(source, lambda f: lengths(f).where("id is null or id <> '13'")).collect()
    assert [e.n_in for e in ledger if e.error] == [sum(e.n_in for e in ledger) - job.accepted().count()]
    other = ResumableTable(spark, str(tmp_path / "other"), RESULT, ["id"], 4)
    moved = other.run(source, lambda f: lengths(f).withColumn("id", F.lit("one"))).collect()
    assert sum(1 for e in moved if e.error) >= 3
    with pytest.raises(AnalysisException):
        other.run(made(spark, 41), lambda f: f.select("nothing"))


def test_an_empty_table(spark, tmp_path):
    job = table(spark, tmp_path)
    assert job.run(made(spark, 0), lengths).count() == 0
    assert job.accepted().count() == job.quarantine().count() == 0
