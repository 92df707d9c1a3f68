"""File ingest: XML reports -> (CODE, ID) rows, XML columns -> rows, TSV folders -> one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.sources.delimited import read_delimited
from riskflow.sources.sinks import write_csv
from riskflow.sources.xmldocs import read_documents, shred

# Element names of the credit report.
CODE_ELEMENT = "code"
ID_ELEMENT = "userRefNumber"
REPORT_ROOT = "creditBureau"


def xml_codes(spark: SparkSession, path: str, one_per_file: bool = True,
              engine: str = "parse", namespace: str | None = None) -> DataFrame:
    """Every ``code`` of every report with the report's first ``userRefNumber``.

    A report with a single code keeps it. ``namespace`` binds both names to one URI; by
    default whatever each file declares matches (``declared_namespace`` gives the first file's).
    """
    docs = read_documents(spark, path, one_per_file=one_per_file)
    return shred(docs, "doc", CODE_ELEMENT, "CODE", {"ID": ID_ELEMENT},
                 engine=engine, namespace=namespace).select("CODE", "ID")


def xml_column_codes(table: DataFrame, xml_col: str = "testxml", id_col: str = "id",
                     root: str = REPORT_ROOT, width: int | None = None, engine: str = "parse",
                     namespace: str | None = None, texts: str = "each") -> DataFrame:
    """Codes under the document root of an XML column, one row per code, with the row id.

    ``namespace`` binds root and codes to one URI; ``texts='first'`` takes the first text of every
    code element, NULL where it has none. Codes are kept whole; ``width`` cuts them to a stored column's width.
    """
    out = shred(table, xml_col, CODE_ELEMENT, "code", root=root, keep=(id_col,), engine=engine, namespace=namespace, texts=texts)
    return out.select((F.substring("code", 1, width) if width else F.col("code")).alias("code"), id_col)


def combine_delimited(spark: SparkSession, path: str, types, sep: str = "\t", on_error: str = "raise") -> DataFrame:
    """All files of a folder as one table (each file once, columns V1..Vn); ragged or mistyped lines raise."""
    return read_delimited(spark, path, types, sep=sep, on_error=on_error)


def xml_folder_to_csv(spark: SparkSession, path: str, out: str, one_per_file: bool = True,
                      namespace: str | None = None) -> None:
    """Directory of reports -> CSV of (CODE, ID) with a header, written by the executors."""
    write_csv(xml_codes(spark, path, one_per_file, namespace=namespace), out)


def delimited_folder_to_csv(spark: SparkSession, path: str, types, out: str, sep: str = "\t"
                            ) -> None:
    """Folder of headerless delimited files -> one CSV with a header."""
    write_csv(combine_delimited(spark, path, types, sep), out)
