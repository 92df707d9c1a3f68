"""The unseen-key append sink driven by a file stream."""

import os
import tempfile

from riskflow.sources.sinks import read_table
from riskflow.streaming import append_unseen_batches


def test_stream_appends_only_unseen_keys(spark):
    base = tempfile.mkdtemp(prefix="rf-stream-")
    src, table, ckpt = (os.path.join(base, n) for n in ("in", "table", "ckpt"))
    schema = "approvalbkey long, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(os.path.join(src, "b1"))
    spark.createDataFrame([(2, "b2"), (3, "c")], schema).write.parquet(os.path.join(src, "b2"))
    q = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
         .option("maxFilesPerTrigger", 1).parquet(src)
         .writeStream.foreachBatch(append_unseen_batches(table, "approvalbkey"))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(120)
    keys = sorted(r[0] for r in read_table(spark, table).select("approvalbkey").collect())
    assert keys == [1, 2, 3]
