"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import pickle
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the whole text (null becomes empty), as ``doc_id`` and ``text``.

    Dropping everything else first keeps clashing extra columns out of the operators.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (the contract's fold rule)."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file: in $TOKENIZER_DIR if set, else in the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory of this process to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_MEMOS: dict[str, Callable[[], bool]] = {}


def remembers(module: str, forget: Callable[[], bool]) -> None:
    """Register how a module lets go of what it keeps between tasks (true if it kept anything)."""
    _MEMOS[module] = forget


def forget(but: str = "") -> None:
    """A worker that served other operators before lets go of what those kept, all modules but this one."""
    if any([clear() for module, clear in _MEMOS.items() if module != but]):
        give_back()


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """``fit`` of a sample of bounded size, run in one task; only the pickled model comes to the driver."""
    columns = sample.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        model = pickle.dumps(fit(pd.concat([pd.DataFrame(columns=columns), *batches])))
        give_back()                                # the worker lives on
        yield pd.DataFrame({"model": [model]})

    models = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else fit(pd.DataFrame(columns=columns))
