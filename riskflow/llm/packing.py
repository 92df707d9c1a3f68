"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bulk-synchronous best fit. A round sorts the unplaced pieces and the open gaps by size and
sweeps both from large to small: each piece goes to the successor of its length, the
smallest gap that holds it and was not yet used in this round. Pieces of one length that
want the same gaps are told apart by rank: the piece of rank r in its length class takes
slot r of the run of gaps matched with that class, as many pieces to a gap as fit. A piece
that only fits a gap already used in this round waits for the next; one that fits no open
gap opens a sequence. Then the gaps are updated, and the next round begins, until
nothing is left.

Where each part runs:

* executors: encoding and cutting (one pass over the texts, no shuffle of them), the
  counts by length (combined map-side), and the ranks inside a length class. A class may
  hold a third of all pieces, so its ranks are taken inside (input partition, length)
  slices and shifted by the slices before; no task gets a whole class.
* the sweep sees only size classes with counts: at most ``capacity`` lengths and
  ``capacity`` gaps, whatever the number of documents. Sequences of equal gap are held as
  runs of consecutive ids, so a round's result is a short list of (length, ranks) ->
  (sequence ids, offset) runs, which the executors apply to their own rows.

Defined results: null text is empty (its piece is the separator alone); repeated rows are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskflow.llm import common, tokens
from riskflow.operators.materialize import materialize

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUN = np.dtype([("length", "i8"), ("rank", "i8"), ("per_gap", "i8"), ("sequence", "i8"), ("offset", "i8")])


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, leading: bool = False) -> DataFrame:
    """Encode (doc_id, text), append ``end_id`` and cut into pieces of at most ``capacity``."""
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(vocabulary, leading)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["doc_id"].astype("Int64")
            for first, last in tokens.in_blocks(texts):
                found = []
                for k, ids in zip(range(first, last), encode(texts[first:last])):
                    ids += end
                    n = len(ids) // 4
                    found += [(k, p, a, min(capacity, n - a), common.crc32(ids[4 * a:4 * (a + capacity)]))
                              for p, a in enumerate(range(0, n, capacity))]
                out = pd.DataFrame(found, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.assign(doc_id=keys.iloc[out["doc_id"]].to_numpy(object, na_value=None))
            del batch, texts
            common.give_back()

    return common.id_and_text(docs).mapInPandas(pieces, PIECE)


def sweep_rounds(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int, int]:
    """Match all size classes; returns (runs, sequences opened, rounds)."""
    left = {int(n): int(c) for n, c in counts.items() if c}
    ranks = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}       # gap -> runs of (first sequence, number)
    runs: list[tuple[int, int, int, int, int]] = []
    opened = rounds = 0
    while left:
        rounds += 1
        updated: dict[int, list[tuple[int, int]]] = {}
        widest = 0                                    # widest gap among those used in this round
        for length in sorted(left, reverse=True):
            fitting = sorted(g for g in gaps if g >= length)
            while left[length]:
                while fitting and not gaps.get(fitting[0]):
                    fitting.pop(0)
                if fitting:
                    gap = fitting[0]
                    first, number = gaps[gap].pop()
                elif widest >= length:
                    break                             # the next round offers those gaps
                else:
                    gap, first = capacity, opened
                    number = -(-left[length] // (capacity // length))
                    opened += number
                fit = gap // length
                full = min(number, left[length] // fit)
                rest = left[length] - full * fit if full < number else 0
                for n_bins, per_gap in ((full, fit), (1 if rest else 0, rest)):
                    if n_bins:
                        runs.append((length, ranks[length], per_gap, first, capacity - gap))
                        ranks[length] += n_bins * per_gap
                        left[length] -= n_bins * per_gap
                        now = gap - per_gap * length
                        if now:
                            updated.setdefault(now, []).append((first, n_bins))
                            widest = max(widest, now)
                        first, number = first + n_bins, number - n_bins
                if number:
                    gaps.setdefault(gap, []).append((first, number))
        left = {n: c for n, c in left.items() if c}
        for gap, found in updated.items():
            gaps.setdefault(gap, []).extend(found)
        gaps = {g: _merged(found) for g, found in gaps.items() if found}
    return np.sort(np.array(runs, dtype=RUN), order=["length", "rank"]), opened, rounds


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, number in sorted(found):
        if out and sum(out[-1]) == first:
            out[-1] = (out[-1][0], out[-1][1] + number)
        else:
            out.append((first, number))
    return out


def ranked(pieces: DataFrame, key: str = "length") -> DataFrame:
    """Adds ``rank``, from 0 inside each value of ``key``, without bringing a value together.

    ``pieces`` must be a written table (so that slices do not move between reads) with a
    ``slice`` column: rows of one value are ranked inside their slice, and the slices of a
    value, one row each, are summed in order.
    """
    inside = Window.partitionBy("slice", key).orderBy("row")
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (pieces.groupBy("slice", key).count()
              .select("slice", key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    return (pieces.withColumn("_inside", F.row_number().over(inside) - 1)
            .join(starts, ["slice", key])
            .withColumn("rank", F.col("_before") + F.col("_inside")).drop("_before", "_inside"))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048,
         leading: bool = False) -> DataFrame:
    """One row per piece, with its sequence and its place there."""
    row = F.monotonically_increasing_id()
    pieces = materialize(cut(docs, vocabulary, end_id, capacity, leading)
                         .withColumn("row", row).withColumn("slice", F.shiftright(row, 33)), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _, _ = sweep_rounds(counts, capacity)
    order = (runs["length"] << 44) + runs["rank"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            run = runs[np.searchsorted(order, (length << 44) + rank, side="right") - 1]
            bin_, slot = np.divmod(rank - run["rank"], run["per_gap"])
            yield batch.drop(columns=["rank"]).assign(doc_id=batch["doc_id"].astype("Int64"), sequence_id=run["sequence"] + bin_,
                                                      offset=run["offset"] + slot * length)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return (ranked(pieces).select(*columns, "rank")
            .mapInPandas(place, PIECE + ", sequence_id long, offset long"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` packed into sequences of 2048; one row per piece."""
    docs = common.id_and_text(common.table(spark, sf_dir, "documents"))
    return pack(docs, common.tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)
