"""``foreachBatch`` sink: append rows whose key is not yet in a parquet table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from riskflow.sources.sinks import append_unseen, replace_table, table_exists


def append_unseen_batches(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Return a ``foreachBatch`` function appending each batch's unseen keys to ``path``.

    Keys repeated inside one batch are appended once each row (like the source's
    INSERT ... NOT IN); a key already stored is never appended again, so a
    replayed batch after a failure appends nothing twice. The first batch creates
    the table; a table that is there but cannot be read fails the batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if table_exists(batch.sparkSession, path):
            append_unseen(batch, path, key)
        else:
            replace_table(batch, path)

    return run
