"""Embedding near-duplicates by cross-polytope hashing.

A hash of a vector: three rounds of seeded random signs and a fast Hadamard transform
rotate it (padded to a power of two); the nearest vertex of the cross-polytope, the
coordinate of largest size and its sign, is the value. ``HASHES`` values and the label make
a table's bucket; there are ``TABLES`` tables. A vector is posted in its own bucket and in
the ``PROBES`` next likeliest ones of each table (the hash whose second vertex is closest
to its first is switched).

Two vectors of equal label that share a bucket are compared by cosine in double precision.
The vectors of a bucket meet block by block: a bucket is cut into blocks of about ``BLOCK``
vectors by a hash of the id, and a task holds one pair of blocks, so no bucket, however
hot, is brought together. Inside a task pairs stay in numpy: what leaves are the number of
links of each vector and a spanning forest of the links found there, never all pairs. A pair that shares several buckets is counted
only in the smallest of them (by table, then bucket value), which both vectors' bucket lists tell; so counts
are exact over the pairs found.

Equal vectors of equal label are one class, compared once; their copies are added to the
counts afterwards.

Defined results: a vector that is null, zero, or holds null or non-finite components, or
has a null label, links with nothing; vectors of different lengths never link (the length
is part of the bucket); repeated ids are vectors of their own for ``n_links`` and one node
for components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.llm import common
from riskflow.llm.components import components
from riskflow.operators.materialize import materialize

TABLES = 10
HASHES = 2
PROBES = 1
COSINE = 0.98
BLOCK = 1500
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis (a power of two), orthonormal."""
    n, shape = x.shape[-1], x.shape
    h = 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(shape) / np.sqrt(n)


def buckets(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Bucket values [n, tables, 1 + probes] of unit vectors [n, d]; a vector's own comes first."""
    n, d = vectors.shape
    size = 1 << max(1, int(d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = vectors
    out = np.empty((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, loss = [], [], []
        for k in range(hashes):
            rng = np.random.default_rng([SEED, size, t, k])
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], size))
            order = np.argpartition(-np.abs(x), min(probes, size - 1), axis=1)[:, :probes + 1]
            order = np.take_along_axis(order, np.argsort(-np.abs(np.take_along_axis(x, order, 1)), axis=1, kind="stable"), 1)
            vertex = 2 * order + (np.take_along_axis(x, order, 1) < 0)
            far = np.abs(np.take_along_axis(x, order, 1))
            best.append(vertex[:, 0])
            second.append(vertex[:, 1:])
            loss.append(far[:, :1] - far[:, 1:])
        own = np.zeros(n, np.int64)
        for v in best:
            own = own * (2 * size) + v
        out[:, t, 0] = own
        if probes:
            # every single switch of one hash, cheapest first
            price = np.concatenate(loss, axis=1)
            switch = np.argsort(price, axis=1, kind="stable")[:, :probes]
            for p in range(probes):
                which, rank = np.divmod(switch[:, p], probes)
                value = np.zeros(n, np.int64)
                for k in range(hashes):
                    value = value * (2 * size) + np.where(which == k, second[k][rows, rank], best[k])
                out[:, t, 1 + p] = value
    return out


def unit(vectors: pd.Series) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None where a vector cannot link."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None else np.asarray(v, dtype=float)
        if x is not None:
            norm = float(np.sqrt((x * x).sum())) if len(x) else 0.0
            if np.isfinite(x).all() and 0 < norm < np.inf:
                out.append(x / norm)
                continue
            scale = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if scale > 0:                          # squares over- or underflow: scale first
                x = x / scale
                out.append(x / np.sqrt((x * x).sum()))
                continue
        out.append(None)
    return out


def post(vectors: DataFrame) -> DataFrame:
    """(id, label) of every vector with its bucket list [table * (1+probes)], null if it cannot link."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = unit(batch["vector"])
            lists: list = [None] * len(units)
            for d in {len(u) for u in units if u is not None}:
                at = [i for i, u in enumerate(units) if u is not None and len(u) == d]
                for i, b in zip(at, buckets(np.stack([units[i] for i in at]))):
                    lists[i] = b.ravel()
            yield batch.assign(id=batch["id"].astype("Int64"), unit=units, buckets=lists)

    return (vectors.select("id", "label", "vector")
            .mapInPandas(hashed, "id long, label string, vector array<double>, unit array<double>, buckets array<long>"))


def _fresh(bx: np.ndarray, by: np.ndarray, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Of pairs with bucket lists ``bx``, ``by`` that meet in (place, bucket): is it the first shared one?"""
    width = 1 + PROBES
    out = np.ones(len(bx), bool)
    for t in range(TABLES):
        before, here = t < place, t == place
        if not (before | here).any():
            continue
        for p in range(width):
            for q in range(width):
                x = bx[:, t * width + p]
                out &= ~((x == by[:, t * width + q]) & (before | (here & (x < bucket))))
    return out


class _Forest:
    """Keeps only the edges that join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, a: int) -> int:
        while (up := self.parent.setdefault(a, a)) != a:
            self.parent[a] = self.parent.setdefault(up, up)
            a = up
        return a

    def add(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def _pairs_of(first: np.ndarray, size: np.ndarray, most: int):
    """(i, j) arrays of all row pairs i < j inside small groups, about ``most`` pairs at a time."""
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(first, size) + inside
    partners = np.repeat(size, size) - 1 - inside
    ends = np.cumsum(partners)
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        n = partners[a:b]
        i = np.repeat(row[a:b], n)
        yield i, i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = b


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Links inside each (bucket, block pair) of rows sorted by them, all of one dimension."""
    units, lists = np.stack(rows["unit"].to_numpy()), np.stack(rows["buckets"].to_numpy())
    ids, copies, block, b0 = (rows[c].to_numpy() for c in ("id", "copies", "block", "b0"))
    one_block = b0 == rows["b1"].to_numpy()
    place, bucket = rows["place"].to_numpy(), rows["bucket"].to_numpy()
    keys = [rows[c].to_numpy() for c in ("label", "place", "bucket", "b0", "b1")]
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    n, forest = np.zeros(len(rows), np.int64), _Forest()

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        met = one_block[i] | (block[i] != block[j])
        i, j = i[met], j[met]
        close = np.einsum("ij,ij->i", units[i], units[j]) >= COSINE
        i, j = i[close], j[close]
        fresh = _fresh(lists[i], lists[j], place[i], bucket[i])
        i, j = i[fresh], j[fresh]
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        for a, b in zip(ids[i].tolist(), ids[j].tolist()):
            forest.add(a, b)

    small = size <= 48
    for i, j in _pairs_of(first[small], size[small], 100_000):
        keep(i, j)
    for a, m in zip(first[~small].tolist(), size[~small].tolist()):
        for c in range(a, a + m, 256):             # a stripe of the block against the rest
            i, j = np.nonzero(units[c:min(c + 256, a + m)] @ units[c:a + m].T >= COSINE - 1e-9)
            ahead = i < j
            keep(i[ahead] + c, j[ahead] + c)
    linked = n > 0
    counts = pd.DataFrame({"id": ids[linked], "n": n[linked]}).groupby("id", as_index=False).sum()
    edges = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"id": np.concatenate([counts["id"], edges[:, 0]]),
                         "n": pd.array(counts["n"].tolist() + [None] * len(edges), dtype="Int64"),
                         "other": pd.array([None] * len(counts) + edges[:, 1].tolist(), dtype="Int64")})


def links(classes: DataFrame) -> DataFrame:
    """(id, n, other): link counts (other null) and forest edges (n null) of the posted classes."""
    width = 1 + PROBES
    posted = classes.select("id", "label", F.size("unit").alias("d"),
                            F.posexplode("buckets").alias("at", "bucket"))
    posted = posted.select("id", "label", "d", F.expr(f"int(at div {width})").alias("place"), "bucket").distinct()
    key = ["d", "label", "place", "bucket"]
    # Buckets of one vector hold no pair; the rest are dealt in blocks of about BLOCK.
    sizes = (posted.groupBy(*key).count().filter("count > 1")
             .withColumn("blocks", F.ceil(F.col("count") / F.lit(BLOCK)).cast("int")))
    dealt = posted.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Block b meets every block: it is sent to the tasks (min, max) of each pair it is in.
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("id", *key, "block", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"))
    rows = sent.join(classes.select("id", "unit", "buckets", "copies"), "id")
    group = [*key, "b0", "b1"]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            tail = batch[group].iloc[-1]
            last = (batch[group] == tail).all(axis=1).to_numpy()
            if held and not (held[-1][group].iloc[-1] == batch[group].iloc[0]).all():
                yield from finish(pd.concat(held, ignore_index=True))
                held = []
            if last.all():                         # the group may go on in the next batch
                held.append(batch)
                continue
            yield from finish(pd.concat([*held, batch[~last]], ignore_index=True))
            held = [batch[last]]
        if held:
            yield from finish(pd.concat(held, ignore_index=True))

    def finish(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, same in rows.groupby("d", sort=False):
            yield _meet(same)

    return (rows.repartition(common.shuffle_partitions(classes.sparkSession), *group)
            .sortWithinPartitions(*group, "id").mapInPandas(meet, "id long, n long, other long"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(id, n_links, component_id) for every row of (id, label, vector)."""
    spark = vectors.sparkSession
    posted = materialize(post(vectors), "posted")
    usable = posted.filter("buckets is not null and label is not null and id is not null")
    # Equal vectors of equal label are one class, named by the smallest id.
    mark = F.sha2(F.concat_ws("|", "label", F.to_json("vector")), 256)
    sized = usable.withColumn("mark", mark)
    of = sized.groupBy("mark").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    chosen = sized.join(of, "mark").filter("id = class").dropDuplicates(["mark"])
    # An id may carry several vectors; classes are told apart by a number of their own.
    classes = materialize(chosen.select(F.xxhash64("mark").alias("id"), "class", "label", "unit", "buckets", "copies", "mark"),
                          "classes")
    found = materialize(links(classes), "links")
    counts = found.filter("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    forest = found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    names = classes.select("id", "class")
    named = (forest.join(names.select(F.col("id").alias("a"), F.col("class").alias("ca")), "a")
             .join(names.select(F.col("id").alias("b"), F.col("class").alias("cb")), "b").select("ca", "cb"))
    own = sized.join(of, "mark").filter("id <> class").select(F.col("id").alias("ca"), F.col("class").alias("cb"))
    tied = components(named.union(own), "ca", "cb")
    per_class = classes.join(counts, "id", "left").select(
        "mark", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    marked = posted.withColumn("mark", F.when(F.expr("buckets is not null and label is not null and id is not null"), mark))
    return (marked.select("id", "mark").join(per_class, "mark", "left")
            .join(tied, F.col("id") == tied["node"], "left")
            .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("component", "id").alias("component_id")))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``; one row per vector with its links and component."""
    vectors = common.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"))
    return near_duplicates(vectors).select(
        F.col("id").alias("vec_id"), "n_links", "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"))


OP2_SQL = """
with recursive v as (select vec_id, label::varchar as label, embedding::double[] as e from embeddings),
bad as (select distinct vec_id from (select vec_id, unnest(e) as c from v) where c is null or not isfinite(c)),
u as (select * from v where label is not null and len(e) > 0 and list_dot_product(e, e) > 0
      and vec_id not in (select vec_id from bad)),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(a, b) as (select vec_id, vec_id from v union select reach.a, l.b from reach join l on reach.b = l.a)
select v.vec_id, coalesce(any_value(n.n), 0)::bigint as n_links, min(reach.b) as component_id, v.vec_id = min(reach.b) as kept
from v join reach on reach.a = v.vec_id left join (select a, count(*) as n from l group by a) n on n.a = v.vec_id group by v.vec_id
"""
