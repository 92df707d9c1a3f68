"""Stored tables: failing jobs, versions, concurrent writers, plain folders, leftovers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskflow.plans import batch, collections as col, retry_cost as rc
from riskflow.sources import sinks


def _path():
    return os.path.join(tempfile.mkdtemp(prefix="rf-stored-"), "table")


def _rows(spark, first, last):
    return spark.range(first, last).withColumnRenamed("id", "approvalbkey")


def _failing(spark):
    """Rows whose last ones raise while they are written, after others are."""
    return spark.range(0, 1000, 1, 4).select(F.when(F.col("id") > 990, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("approvalbkey"))


def _keys(spark, path, **how):
    return sorted(r[0] for r in sinks.read_table(spark, path, **how).collect())


@pytest.mark.parametrize("plain", [True, False])
def test_a_failing_replacement_leaves_the_stored_rows(spark, plain):
    path = _path()
    if plain:
        _rows(spark, 0, 100).write.parquet(path)
    else:
        sinks.replace_table(_rows(spark, 0, 100), path)
    before = sorted(os.listdir(path))
    for write in (lambda: sinks.replace_table(_failing(spark), path), lambda: sinks.append_unseen(_failing(spark), path, "approvalbkey"),
                  lambda: col.store_list(_failing(spark), path, full_refresh=True), lambda: col.store_list(_failing(spark), path)):
        with pytest.raises(Exception, match="no"):
            write()
        assert _keys(spark, path) == list(range(100)) and sorted(os.listdir(path)) == before


def test_the_published_reports_survive_a_failing_run(spark, monkeypatch):
    path = _path()
    sinks.replace_table(_rows(spark, 0, 100), path)
    monkeypatch.setattr(rc, "retry_report", lambda *a, **k: _failing(spark))
    with pytest.raises(Exception, match="no"):
        rc.publish_retry_report(path, spark)
    monkeypatch.setattr(batch, "assemble", lambda *a: None)
    for name, value in (("cohort_tables", lambda *a: (None, None)), ("with_distance", lambda m: m), ("bin_features", lambda *a: None)):
        monkeypatch.setattr(batch.fe, name, value)
    monkeypatch.setattr(batch.sc, "score", lambda *a: None)
    monkeypatch.setattr(batch.sc, "Grades", lambda *a: type("G", (), {"final": _failing(spark)}))
    with pytest.raises(Exception, match="no"):
        batch.score_batch(lambda name: None, None, path, None)
    assert _keys(spark, path) == list(range(100))


def test_a_failing_first_write_is_no_table(spark):
    path = _path()
    with pytest.raises(Exception, match="no"):
        sinks.replace_table(_failing(spark), path)
    assert not sinks.table_exists(spark, path)
    assert col.store_list(_rows(spark, 0, 3), path) == 3


def test_versions_are_kept_for_readers_and_old_ones_go(spark):
    path = _path()
    sinks.replace_table(_rows(spark, 0, 3), path)
    reader = sinks.read_table(spark, path)
    sinks.replace_table(_rows(spark, 5, 7), path)
    assert sorted(r[0] for r in reader.collect()) == [0, 1, 2]          # planned before the replacement
    assert sinks.append_unseen(_rows(spark, 6, 9), path, "approvalbkey") == 2
    assert sinks.append_unseen(_rows(spark, 6, 9), path, "approvalbkey") == 0
    assert sinks.versions(spark, path) == [2, 3]
    assert _keys(spark, path) == [5, 6, 7, 8] and _keys(spark, path, version=2) == [5, 6]
    with pytest.raises(ValueError):
        sinks.read_table(spark, path, version=1)
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 2
    assert not [n for n in os.listdir(path) if n.startswith(("_draft", "_staging"))]


def test_a_replacement_may_read_the_table_it_replaces(spark):
    path = _path()
    sinks.replace_table(_rows(spark, 0, 5), path)
    sinks.replace_table(sinks.read_table(spark, path).filter("approvalbkey < 2"), path)
    assert _keys(spark, path) == [0, 1]


def test_a_plain_folder_is_taken_over(spark):
    path = _path()
    _rows(spark, 0, 3).write.parquet(path)
    assert sinks.append_unseen(_rows(spark, 2, 5), path, "approvalbkey") == 2
    assert _keys(spark, path) == [0, 1, 2, 3, 4]
    assert not [n for n in os.listdir(path) if n.endswith(".parquet")]


def test_the_later_of_two_writers_raises(spark):
    path = _path()
    sinks.replace_table(_rows(spark, 0, 3), path)
    sinks._commit(spark, path, 2, sinks._parts(spark, path, 1))         # another writer, meanwhile
    with pytest.raises(sinks.ConcurrentWrite):
        sinks._write(_rows(spark, 7, 9), path, 1, [])
    assert _keys(spark, path) == [0, 1, 2]
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 1


def test_partitioned_tables(spark):
    path = _path()
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "approvalbkey long, kind string")
    sinks.replace_table(rows, path, partition_by=["kind"])
    assert sorted(tuple(r) for r in sinks.read_table(spark, path).select("approvalbkey", "kind").collect()) == [(1, "a"), (2, "b")]
