"""Token-ID binary output: length-delimited records with a separate offset index.

File format (all integers little-endian). A shard is a run of frames:

    uint64 length | uint32 masked crc of those 8 bytes | payload | uint32 masked crc of payload

payload: uint8 id width in bytes (2 or 4), uint8 1 if the document id is null, int64
document id, then the token ids. The mask rotates the crc32 right by 15 bits and adds a
constant, so that a checksum stored inside checksummed data does not degenerate.

Beside each shard ``part-N.rec`` lies ``part-N.idx``: one 24-byte entry per record (uint64
offset of the frame, uint64 frame length, uint64 ids before it in the shard), which lets a
reader fetch records in any order without scanning the shard.

Writing: documents are range-partitioned and sorted by id; a task streams its range into
one shard, under a name of its own, and renames it when it is complete, so a retried or
speculative attempt replaces a shard by an equal one and a lost executor loses nothing.
Files go through pyarrow's file systems to the folder given (a path or URI that all
machines share).

Defined results: null text is empty (only the end id); a null id sorts first; repeated ids
follow each other by text, each a record; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskflow.llm import common, tokens
from riskflow.operators.materialize import materialize, scratch_folder

MASK_DELTA = 0xA282EAD8
FRAME = struct.Struct("<QI")
HEAD = struct.Struct("<BBq")
BLOCK_CHARS = 4_000_000                          # a larger block names fewer of its distinct words again
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("ids_before", "<u8")])
MANIFEST = "shard int, path string, records long, ids long"
RECORD = "shard int, position long, doc_id long, start long, n_tokens long, ids binary"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(common.crc32(length))), payload,
                     struct.pack("<I", masked(common.crc32(payload)))))


def unframe(data: bytes, offset: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``offset`` and the offset behind it; raises if damaged."""
    length, crc = FRAME.unpack_from(data, offset)
    if masked(common.crc32(data[offset:offset + 8])) != crc:
        raise ValueError(f"damaged length at {offset}")
    begin = offset + FRAME.size
    payload = bytes(data[begin:begin + length])
    (crc,) = struct.unpack_from("<I", data, begin + length)
    if len(payload) != length or masked(common.crc32(payload)) != crc:
        raise ValueError(f"damaged record at {offset}")
    return payload, begin + length + 4


def pack_ids(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """``ids`` are unsigned 32-bit; written in ``width`` bytes each."""
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return HEAD.pack(width, doc_id is None, doc_id or 0) + ids


def unpack_ids(payload: bytes) -> tuple[int | None, bytes]:
    width, null, doc_id = HEAD.unpack_from(payload)
    ids = payload[HEAD.size:]
    if width == 2:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return (None if null else doc_id), ids


def _filesystem(uri: str):
    from pyarrow import fs
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, leading: bool = True,
          partitions: int | None = None) -> DataFrame:
    """Encode (doc_id, text) and write it in ascending id order; returns the manifest,
    one row per shard, as a table already written (so the shards exist)."""
    spark = docs.sparkSession
    partitions = partitions or common.shuffle_partitions(spark)

    def write_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        encode = tokens.encoder(vocabulary, leading)
        width = 2 if max(encode.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.uint32(end_id).astype("<u4").tobytes()
        out, entries, at, before, store, base = None, [], 0, 0, None, None
        for batch in batches:
            texts = batch["text"].tolist()
            keys = batch["doc_id"].astype("Int64").tolist()
            for first, last in tokens.in_blocks(texts, BLOCK_CHARS):
                for key, ids in zip(keys[first:last], encode(texts[first:last])):
                    if out is None:
                        store, root = _filesystem(folder)
                        store.create_dir(root, recursive=True)
                        base = f"{root}/part-{shard:05d}"
                        attempt = f"{root}/.attempt-{shard:05d}-{uuid.uuid4().hex}"
                        out = store.open_output_stream(attempt)
                    record = frame(pack_ids(None if key is pd.NA else int(key), ids + end, width))
                    out.write(record)
                    n = len(ids) // 4 + 1
                    entries.append((at, len(record), before))
                    at += len(record)
                    before += n
        if out is not None:
            out.close()
            with store.open_output_stream(attempt + ".idx") as index:
                index.write(np.array(entries, dtype=ENTRY).tobytes())
            store.move(attempt + ".idx", base + ".idx")
            store.move(attempt, base + ".rec")
            yield pd.DataFrame({"shard": [shard], "path": [f"{folder.rstrip('/')}/part-{shard:05d}"],
                                "records": [len(entries)], "ids": [before]})

    ordered = (common.id_and_text(docs).repartitionByRange(partitions, F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    return materialize(ordered.mapInPandas(write_shard, MANIFEST), "record-manifest")


def read(manifest: DataFrame, shuffle_seed: int | None = None, block: int = 2048) -> DataFrame:
    """Records of the shards, checked against their checksums; ``start`` counts the ids of
    all records before, over all shards in order.

    A read task takes a block of index entries, not a whole shard. With ``shuffle_seed``
    the blocks' entries are dealt in a seeded random order and fetched by offset.
    """
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                store, base = _filesystem(row.path)
                with store.open_input_file(base + ".idx") as f:
                    f.seek(int(row.first) * ENTRY.itemsize)
                    index = np.frombuffer(f.read(int(row.n) * ENTRY.itemsize), ENTRY)
                order = np.arange(len(index))
                if shuffle_seed is not None:
                    np.random.default_rng([shuffle_seed, int(row.shard), int(row.first)]).shuffle(order)
                found, held = [], 0
                with store.open_input_file(base + ".rec") as f:
                    for k in order:
                        f.seek(int(index["offset"][k]))
                        payload, _ = unframe(f.read(int(index["length"][k])))
                        doc_id, ids = unpack_ids(payload)
                        found.append((row.shard, int(row.first + k), doc_id,
                                      int(row.shard_start + index["ids_before"][k]), len(ids) // 4, ids))
                        held += len(ids)
                        if held > 8_000_000:
                            yield _records(found)
                            found, held = [], 0
                if found:
                    yield _records(found)

    spark = manifest.sparkSession
    # One row per shard: the single ordered window is bounded by the number of files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (manifest.withColumn("shard_start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
              .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"),
                                                        F.col("records") - 1, F.lit(block).cast("long"))))
              .select("shard", "path", "shard_start", "first",
                      F.least(F.lit(block), F.col("records") - F.col("first")).alias("n")))
    if shuffle_seed is None:
        blocks = blocks.repartition(common.shuffle_partitions(spark), "shard", "first")
    else:
        blocks = blocks.repartition(common.shuffle_partitions(spark), F.xxhash64("shard", "first", F.lit(shuffle_seed)))
    return blocks.mapInPandas(fetch, RECORD)


def _records(found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["shard", "position", "doc_id", "start", "n_tokens", "ids"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


def op4_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through the record files and back; one row per document."""
    docs = common.id_and_text(common.table(spark, sf_dir, "documents"))
    folder = scratch_folder(spark, "record-files")
    manifest = write(docs, folder, common.tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
