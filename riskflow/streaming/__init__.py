"""Incremental loading.

The source scripts have no stream, watermark or stateful operator; their one
incremental step is "append list rows whose key is not stored yet". That sink
is offered here in micro-batch form for ``writeStream.foreachBatch`` so a
collection list can be fed by a file stream of new candidate rows.
"""

from riskflow.streaming.incremental import append_unseen_batches  # noqa: F401
