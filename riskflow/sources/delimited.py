"""Headerless delimited files: a whole directory read as one DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BAD = "_bad_line"


def default_names(n: int) -> list[str]:
    """Column names a headerless read gives: V1 .. Vn."""
    return [f"V{i}" for i in range(1, n + 1)]


def _scan(spark: SparkSession, path: str, types: Sequence, sep: str, names: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    names = list(names) if names else default_names(len(types))
    schema = StructType([StructField(n, t, True) for n, t in zip(names, types)] + [StructField(_BAD, StringType())])
    # without pruning every line is cut into all its fields, so that a ragged one shows whatever is selected
    return (spark.read.option("sep", sep).option("header", "false").option("mode", "PERMISSIVE").option("columnPruning", "false")
            .option("columnNameOfCorruptRecord", _BAD).schema(schema).csv(path)
            .withColumn("_file", F.col("_metadata.file_path"))), names


def _all_read(names: Sequence[str]) -> Column:
    """Always true, but of all fields: Spark checks the types of those that a plan reads."""
    return F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names], F.lit("")) >= ""


def read_delimited(spark: SparkSession, path: str, types: Sequence, sep: str = "\t",
                   names: Sequence[str] | None = None, on_error: str = "raise") -> DataFrame:
    """Read every file of ``path`` (no header) with an explicit schema.

    One scan over all files: Spark splits files into tasks, so there is no
    per-file loop, no driver-side concatenation, and each file is read once.

    A line with too few or too many fields, or a field that is not of its type, raises with its
    file and text (``on_error='raise'``), whichever columns are read of it; with ``'drop'`` such lines are
    left out here and listed by ``malformed_lines``. An empty field is NULL; blank lines are skipped.
    """
    if on_error not in ("raise", "drop"):
        raise ValueError(on_error)
    rows, names = _scan(spark, path, types, sep, names)
    bad = F.col(_BAD).isNotNull()
    if on_error == "raise":
        told = F.raise_error(F.concat(F.lit("malformed line in "), F.col("_file"), F.lit(": "), F.col(_BAD)))
        sound = F.when(bad, told.cast("boolean")).otherwise(_all_read(names))
    else:
        sound = ~bad & _all_read(names)
    return rows.filter(sound).select(*names)


def malformed_lines(spark: SparkSession, path: str, types: Sequence, sep: str = "\t",
                    names: Sequence[str] | None = None) -> DataFrame:
    """(file, line): the lines that ``read_delimited`` does not take, as they stand in their files."""
    rows, names = _scan(spark, path, types, sep, names)
    return (rows.filter(F.col(_BAD).isNotNull() & _all_read(names))
            .select(F.col("_file").alias("file"), F.col(_BAD).alias("line")))
