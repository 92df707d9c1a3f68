"""Sinks: stored tables with atomic versions (replace, append unseen keys), CSV.

A stored table is a folder with one ``data-...`` folder a write and small commit files
``_commit-<number>``, each the list of the data folders that make up one version; the highest number
is the table. A write goes beside what is there, and its commit file, renamed into place once
all rows are written, is the one step that shows it: until then, and for good if the job
fails, readers have the version before. Replace lists the new data alone, append adds to the list.
Two writers that started from one version cannot both commit: the later one raises.

The versions before the last ``KEPT`` are removed after a commit; the kept ones let running
readers finish, and ``read_table(..., version=n)`` reads them. A plain parquet folder counts as version 0;
the first write to it takes its rows over. On an object store the rename is a copy, which is
atomic for one small file as well.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from riskflow.operators.dedup import not_in_keys
from riskflow.operators.materialize import delete_folder

KEPT = 2
_COMMIT = "_commit-"


class ConcurrentWrite(RuntimeError):
    """Another writer committed since this one read the table."""


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, store = _folder(spark, path)
    return [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions that are kept, oldest first."""
    return sorted(int(n.removeprefix(_COMMIT)) for n in _names(spark, path) if n.startswith(_COMMIT) and n.removeprefix(_COMMIT).isdigit())


def _parts(spark: SparkSession, path: str, version: int) -> list[str]:
    file, store = _folder(spark, f"{path}/{_COMMIT}{version:08d}")
    stream = store.open(file)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())["data"]
    finally:
        stream.close()


def _plain_files(spark: SparkSession, path: str) -> list[str]:
    """What a plain parquet folder holds: data files and partition folders."""
    return [n for n in _names(spark, path) if not n.startswith(("_", ".", "data-"))]


def table_exists(spark: SparkSession, path: str) -> bool:
    """Has the folder a committed version, or (as a plain folder) any data file? Only their absence
    means a first run: a table that is there but cannot be read must raise where it is read, never be
    taken for an absent one. What a failed first write left behind is no table."""
    return bool(versions(spark, path) or _plain_files(spark, path))


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored table as of its last commit, or of a kept version."""
    path = path.rstrip("/")
    committed = versions(spark, path)
    if not committed and version is None:
        return spark.read.parquet(path)
    n = committed[-1] if version is None else version
    if n not in committed:
        raise ValueError(f"{path} has no version {n}; kept are {committed}")
    return spark.read.parquet(*[f"{path}/{p}" for p in _parts(spark, path, n)])


def _commit(spark: SparkSession, path: str, version: int, parts: list[str]) -> None:
    target, store = _folder(spark, f"{path}/{_COMMIT}{version:08d}")
    draft, _ = _folder(spark, f"{path}/_draft-{uuid.uuid4().hex}")
    stream = store.create(draft, False)
    try:
        stream.write(bytearray(json.dumps({"data": parts}).encode()))
    finally:
        stream.close()
    if store.exists(target) or not store.rename(draft, target):
        store.delete(draft, False)
        raise ConcurrentWrite(f"version {version} of {path} was written meanwhile")


def _clean(spark: SparkSession, path: str) -> None:
    """Remove what no kept version lists."""
    committed = versions(spark, path)
    kept = {p for n in committed[-KEPT:] for p in _parts(spark, path, n)}
    for n in committed[:-KEPT]:
        listed = _parts(spark, path, n)
        delete_folder(spark, f"{path}/{_COMMIT}{n:08d}")
        for p in set(listed) - kept:
            delete_folder(spark, f"{path}/{p}")
    for name in _plain_files(spark, path):                 # taken over by the first commit
        delete_folder(spark, f"{path}/{name}")


def _write(df: DataFrame, path: str, before: int, kept: list[str], partition_by: list[str] | None = None) -> str:
    """Write ``df`` as new data of ``path`` and commit it behind ``kept``; the data's folder."""
    spark, data = df.sparkSession, f"data-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{data}")
        _commit(spark, path, before + 1, [*kept, data])
    except BaseException:
        delete_folder(spark, f"{path}/{data}")
        raise
    _clean(spark, path)
    return data


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """``DROP TABLE t; SELECT ... INTO t``: the new rows become the table once they are all written.

    ``df`` may read the table that it replaces.
    """
    path = path.rstrip("/")
    _write(df, path, max(versions(df.sparkSession, path), default=0), [], partition_by)


def append_unseen(df: DataFrame, path: str, key: str) -> int:
    """``INSERT INTO t SELECT * FROM new WHERE key NOT IN (SELECT key FROM t)``.

    The new rows are computed against one version of the table and committed as the next; if
    the table has changed meanwhile the append raises and leaves it as it is. Without new rows
    nothing is committed. Returns the number of appended rows.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    before = max(versions(spark, path), default=0)
    stored = read_table(spark, path)
    kept = _parts(spark, path, before) if before else []
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    try:
        not_in_keys(df, key, stored).write.parquet(staging)
        fresh = spark.read.schema(df.schema).parquet(staging)
        number = fresh.count()
        if number:
            _write(fresh if before else stored.unionByName(fresh), path, before, kept)
    finally:
        delete_folder(spark, staging)
    return number


def write_documents(docs: DataFrame, path: str) -> None:
    """One file per row of a text column, all in one folder (a folder for each is one more to make and to list).

    The rows are dealt over the cores first, as a few bytes each fit into one task otherwise."""
    (docs.repartition(docs.sparkSession.sparkContext.defaultParallelism)
         .write.option("maxRecordsPerFile", 1).text(path))


def write_csv(df: DataFrame, path: str, quote_all: bool = True) -> None:
    """CSV with a header and no row names; strings quoted like R's ``write.csv``."""
    (df.write.mode("overwrite").option("header", "true")
       .option("quoteAll", str(quote_all).lower()).csv(path))
