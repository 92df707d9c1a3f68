"""Ranked lexical search: Block-Max MaxScore over sharded inverted lists.

Index. A task cuts its documents into shards of about ``SHARD_BYTES``; a shard's documents are
numbered, ``BLOCK`` numbers to a block. A term's list in a shard holds, block by block, the
compressed postings (a byte a place, the counts in one or four bytes, or left out if all are 1)
and beside them the block's best (count, length) pairs: those that no other of the block beats in
both. From them the block's highest impact follows exactly once the corpus statistics are
known, so texts are read once. Lists are kept for the terms of the stated queries alone.

Search. Every task evaluates all queries of a pass on its shards:

* a list's bound is its weight times its highest block impact; lists are taken by falling bounds.
  While the bounds left could lift an unseen document to the threshold (the k-th best score so far,
  of scores that only grow), a list is essential and read whole;
* the lists behind are non-essential. Candidates are the documents seen; one whose score and block
  maxima of all lists left stay below the threshold is rejected, and of each further list only
  the blocks that still hold a candidate are decompressed;
* a shard gives its k best of each query; these heaps are merged, k at most from each task, then by query.

Rejection is strict, so documents that tie with the k-th stay to be told apart by id.

Bounds: queries are taken in passes of about ``PASS_TERMS`` (query, term) pairs, which the driver
holds and sends to the tasks, with the terms' document counts; a shard's lists are one
task's memory. The index of a pass is a written table; nothing else grows with the corpus.

Defined results: a null or termless text is no document and no query; repeated documents rank
beside each other; a null doc_id ranks behind others of its score; queries are the distinct
(item_id, text) rows; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskflow.llm import common
from riskflow.operators.materialize import materialize

BLOCK = 128
SHARD_BYTES = 32_000_000
PASS_TERMS = 200_000
TOP = 10

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes((b | 0x20) if 65 <= b <= 90 else b if b >= 128 or b in _KEPT else 0x20 for b in range(256))

INDEX = ("shard long, term int, df long, occurrences long, blocks binary, counts binary, offsets binary, "
         "best_block binary, best_tf binary, best_n binary, postings binary")


def terms(text: str) -> list[bytes]:
    """The terms of a text in order; only A-Z are lower-cased."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def norm(n, documents: int, total: int):
    return 25 + (75 * n * documents) // total


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class ShardWriter:
    """Collects one shard's documents and gives its index rows."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.term: list[int] = []
        self.tf: list[int] = []
        self.held: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found = terms(text)
        self.bytes += len(text)
        if not found:
            return
        counts = Counter(found)
        hits = self.vocabulary.keys() & counts.keys()
        self.term += [self.vocabulary[t] for t in hits]
        self.tf += [counts[t] for t in hits]
        self.held.append(len(hits))
        self.ids.append(doc_id)
        self.sizes.append(len(found))

    def rows(self, shard: int) -> list[tuple]:
        if not self.ids:
            return []
        sizes = np.array(self.sizes, np.int64)
        empty = b""
        null = np.array([x is None for x in self.ids])
        ids = np.array([x or 0 for x in self.ids], np.int64)
        out = [(shard, -1, len(ids), int(sizes.sum()), ids.tobytes(), sizes.tobytes(), np.packbits(null).tobytes(), *[empty] * 4)]
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), self.held)
        term, tf = np.array(self.term, np.int64), np.array(self.tf, np.int64)
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        if not len(doc):
            return out
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] // BLOCK != doc[:-1] // BLOCK)])
        counts = np.diff(np.r_[starts, len(doc)])
        segment = np.repeat(np.arange(len(starts)), counts)
        # the pairs of a block that no other of it beats in count and length
        by = np.lexsort((sizes[doc], -tf, segment))
        n = sizes[doc][by]
        low = n - segment[by] * (n.max() + 1)
        best = by[low < np.r_[np.iinfo(np.int64).max, np.minimum.accumulate(low)[:-1]]]
        edges = np.flatnonzero(np.r_[True, term[starts][1:] != term[starts][:-1], True])
        best_edges = np.searchsorted(segment[best], edges)
        place, top = (doc % BLOCK).astype(np.uint8), np.maximum.reduceat(tf, starts)
        for a, b, x, y in zip(edges, edges[1:], best_edges, best_edges[1:]):
            parts, offsets, at = [], [], 0
            for k in range(a, b):
                s, e = starts[k], starts[k] + counts[k]
                wide = top[k] > 255
                part = bytes([0 if top[k] == 1 else 2 if wide else 1]) + place[s:e].tobytes()
                if top[k] > 1:
                    part += tf[s:e].astype("<u4" if wide else np.uint8).tobytes()
                parts.append(part)
                offsets.append(at)
                at += len(part)
            mine = best[x:y]
            out.append((shard, int(term[starts[a]]), int(counts[a:b].sum()), 0, (doc[starts[a:b]] // BLOCK).astype("<i4").tobytes(),
                        counts[a:b].astype("<i4").tobytes(), np.array(offsets, "<i8").tobytes(), (segment[mine] - a).astype("<i4").tobytes(),
                        tf[mine].astype("<i8").tobytes(), sizes[doc[mine]].astype("<i8").tobytes(), b"".join(parts)))
        return out


class PostingList:
    """One term's list in a shard: block maxima at hand, postings decompressed on demand."""

    def __init__(self, row, m: np.ndarray, documents: int, total: int):
        self.blocks = np.frombuffer(row.blocks, "<i4")
        self.counts = np.frombuffer(row.counts, "<i4")
        self.offsets = np.frombuffer(row.offsets, "<i8")
        self.postings, self.m = row.postings, m
        best = impact(np.frombuffer(row.best_tf, "<i8"), norm(np.frombuffer(row.best_n, "<i8"), documents, total))
        self.highest = np.zeros(len(self.blocks), np.int64)
        np.maximum.at(self.highest, np.frombuffer(row.best_block, "<i4"), best)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of the k-th block, decompressed once."""
        if k not in self.open:
            n, at = int(self.counts[k]), int(self.offsets[k])
            kind = self.postings[at]
            doc = np.frombuffer(self.postings, np.uint8, n, at + 1).astype(np.int64) + int(self.blocks[k]) * BLOCK
            tf = (np.ones(n, np.int64) if kind == 0 else
                  np.frombuffer(self.postings, np.uint8 if kind == 1 else "<u4", n, at + 1 + n).astype(np.int64))
            self.open[k] = doc, impact(tf, self.m[doc])
        return self.open[k]

    def part(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(int(k)) for k in at]
        return np.concatenate([d for d, _ in found]), np.concatenate([x for _, x in found])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            self.whole = self.part(np.arange(len(self.blocks)))
        return self.whole


class Shard:
    """A shard's documents and lists, from its index rows."""

    def __init__(self, rows, documents: int, total: int):
        lists = {}
        for row in rows:
            if row.term < 0:
                self.ids, sizes = np.frombuffer(row.blocks, np.int64), np.frombuffer(row.counts, np.int64)
                self.null = np.unpackbits(np.frombuffer(row.offsets, np.uint8), count=len(self.ids)).astype(bool)
            else:
                lists[row.term] = row
        m = norm(sizes, documents, total)
        self.lists = {t: PostingList(row, m, documents, total) for t, row in lists.items()}
        self.n_blocks = -(-len(self.ids) // BLOCK)

    def search(self, query: list[tuple[int, int]], k: int) -> list[tuple[int | None, int]]:
        """(term, weight) pairs -> the k best (doc_id, score), best first."""
        held = [(w, self.lists[t]) for t, w in query if w > 0 and t in self.lists]
        if not held:
            return []
        held.sort(key=lambda x: -x[0] * int(x[1].highest.max()))
        bounds = [w * int(x.highest.max()) for w, x in held]
        left = np.cumsum(bounds[::-1])[::-1].tolist() + [0]
        score = np.zeros(len(self.ids), np.int64)
        threshold, i = 1, 0
        while i < len(held) and left[i] >= threshold:                  # essential lists
            w, x = held[i]
            doc, value = x.all()
            score[doc] += w * value
            i += 1
            threshold = max(threshold, self._kth(score, k))
        seen = np.flatnonzero(score)
        if i < len(held):
            # block maxima of the lists left, summed from the last
            maxima = np.zeros((len(held) - i + 1, self.n_blocks), np.int64)
            for j in range(len(held) - 1, i - 1, -1):
                w, x = held[j]
                maxima[j - i] = maxima[j - i + 1]
                maxima[j - i, x.blocks] += w * x.highest
            for j in range(i, len(held)):
                seen = seen[score[seen] + maxima[j - i][seen // BLOCK] >= threshold]
                w, x = held[j]
                wanted = np.zeros(self.n_blocks, bool)
                wanted[seen // BLOCK] = True
                at = np.flatnonzero(wanted[x.blocks])
                if len(at):
                    doc, value = x.part(at) if len(at) < len(x.blocks) else x.all()
                    score[doc] += w * value
                    threshold = max(threshold, self._kth(score[seen], k))
        seen = seen[score[seen] >= threshold]
        order = np.lexsort((self.ids[seen], self.null[seen], -score[seen]))[:k]
        return [(None if self.null[d] else int(self.ids[d]), int(score[d])) for d in seen[order]]

    @staticmethod
    def _kth(score: np.ndarray, k: int) -> int:
        return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, text) -> the index rows of the vocabulary's terms; one pass over the texts, no shuffle."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        number, shard = context.partitionId() << 24, ShardWriter(vocabulary)
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            for doc_id, text in zip(ids.array, batch["text"]):
                shard.add(None if doc_id is pd.NA else int(doc_id), text)
                if shard.bytes >= SHARD_BYTES:
                    yield pd.DataFrame(shard.rows(number), columns=names)
                    number, shard = number + 1, ShardWriter(vocabulary)
        yield pd.DataFrame(shard.rows(number), columns=names)

    # ids as text: a null would make pandas read them as doubles
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(write, INDEX)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, text) -> one row a distinct query and term: (item_id, query, term, q)."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, x, t, q) for i, x, text in zip(batch["item_id"], batch["query"], batch["text"])
                     for t, q in Counter(terms(text)).items()]
            yield pd.DataFrame(found, columns=["item_id", "query", "term", "q"])

    named = (items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
             .distinct().withColumn("query", F.sha2(F.concat_ws(":", F.coalesce("item_id", F.lit("-")), "text"), 256)))
    return named.select("item_id", "query", "text").mapInPandas(cut, "item_id string, query string, term binary, q long")


def _search_pass(docs: DataFrame, held: pd.DataFrame, k: int) -> DataFrame:
    """The shard heaps of one pass's queries: (item_id, query, doc_id, score)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for t in held["term"]}))}
    index = materialize(build_index(docs, vocabulary), "lexical-index")
    stats = index.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences")).collect()   # the vocabulary's size
    df = {r["term"]: r["df"] for r in stats}
    documents, total = df.pop(-1, 0), sum(r["occurrences"] for r in stats)
    weights = {t: weight(documents, n) for t, n in df.items()}
    queries: dict[tuple, list[tuple[int, int]]] = {}
    for item, query, term, q in zip(held["item_id"], held["query"], held["term"], held["q"]):
        number = vocabulary[bytes(term)]
        if weights.get(number, 0) > 0:
            queries.setdefault((item, query), []).append((number, int(q) * weights[number]))
    sent = spark.sparkContext.broadcast(queries)           # at most a pass's pairs

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows.itertuples(index=False), documents, total)
        found = [(item, query, None if d is None else str(d), s) for (item, query), terms_ in sent.value.items() for d, s in shard.search(terms_, k)]
        return pd.DataFrame(found, columns=["item_id", "query", "doc_id", "score"])

    return (index.repartition(common.shuffle_partitions(spark), "shard").groupBy("shard")
            .applyInPandas(search, "item_id string, query string, doc_id string, score long"))


def ranking(docs: DataFrame, items: DataFrame, k: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> (item_id, rank, doc_id, score), the k best of each query."""
    spark, pairs = docs.sparkSession, materialize(query_terms(items), "queries")
    passes = max(1, -(-pairs.count() // pass_terms))
    docs, heaps = docs.select("doc_id", "text").filter("text is not null"), None
    for p in range(passes):
        part = pairs if passes == 1 else pairs.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == p)
        found = materialize(_search_pass(docs, part.toPandas(), k), "heaps")
        heaps = found if heaps is None else heaps.unionByName(found)
    order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    typed = heaps.select(F.col("item_id").cast("long").alias("item_id"), "query", F.col("doc_id").cast("long").alias("doc_id"), "score")
    best = typed.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` ranked for every ``benchmark`` item."""
    return ranking(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS_SQL} as words from documents where text is not null),
q as (select item_id, text, term, count(*) as q from (select item_id, text, unnest({_TERMS_SQL}) as term
      from (select distinct item_id, text from benchmark where text is not null)) group by all),
s as (select count(*) as n_docs, sum(len(words))::bigint as total from d where len(words) > 0),
t as (select r, term, count(*) as tf from (select r, unnest(words) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from t, s group by term, n_docs),
x as (select item_id, q.text, d.doc_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(words) * n_docs) // total))))::bigint as score
      from q join w using (term) join t using (term) join d using (r), s group by all),
y as (select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank from x where score > 0)
select item_id, rank::int as rank, doc_id, score from y where rank <= {TOP}
"""
