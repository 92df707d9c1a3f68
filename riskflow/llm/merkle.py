"""Merkle manifest of a documents table by bitmap-rank indexing.

A row is a leaf, the sha256 of its fields; the leaves of a group (``lang``) ascend by
``doc_id``. Their places come from rank queries, not from a sort:

* bitmaps: a group's ids are kept as 64-bit words, only those that hold an id, so a sparse
  range costs one word an id and a dense one a bit. Map tasks build partial words (``bit_or``)
  and the shuffle merges them.
* popcount directories: counts of words are summed by 2^16, 2^32 and 2^48 ids; each level is
  prefix-summed inside its parent, at most 65,536 entries, so no task gets a whole group.
* rank of an id: its word's directory entry plus the bits below its own. A word that counts more
  rows than bits holds a repeated id (or null): its rows are ranked by (id, leaf digest),
  again by prefix counts of at most 65,536 digest ranges; equal rows are one entry with a number.

Rank r of a group lies in slot r % ``BLOCK`` of block r // ``BLOCK``. A block is an array of slots
keyed by (group, block); one pass reduces it by log2(``BLOCK``) levels to one node, which is a slot
of the next level's block, until a group has one node, its subroot. Subroots, in the order of the
groups, are reduced by the same passes to the root. Then paths go down again: a block's path
joins its parent's, and each leaf's siblings are read off its block.

The texts are read once, by the digest; what is shuffled and stored is the digests.

Defined results: a null lang is a group of its own, before all others; null ids come first in
their group, ordered by digest, as are rows that repeat an id; equal rows take neighbouring
places and have a proof each; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskflow.llm import common
from riskflow.operators.materialize import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10
BLOCK = 1 << LEVELS
NULL_WORD = -(1 << 57) - 1          # below the word of any 64-bit id


def encoded(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[encoded(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def group_key(lang: Column) -> Column:
    """A never-null key whose byte order is null first, then lang's."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def word_of(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id, 6), F.lit(NULL_WORD))


def _earlier(n: str, within: list[str], order: list[str]) -> Column:
    """Sum of ``n`` over the rows ahead in a bounded parent."""
    window = Window.partitionBy("g", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(window), F.lit(0).cast("long"))


def directory(words: DataFrame) -> DataFrame:
    """The bitmap words (g, word, n, ...) with ``before``, the rows of the group ahead of each."""
    chunks = (words.groupBy("g", F.shiftright("word", 10).alias("k16"), F.shiftright("word", 26).alias("k32"),
                            F.shiftright("word", 42).alias("k48")).agg(F.sum("n").alias("n")))
    middle = chunks.groupBy("g", "k32", "k48").agg(F.sum("n").alias("n"))
    top = middle.groupBy("g", "k48").agg(F.sum("n").alias("n"))
    ahead = (chunks.withColumn("a", _earlier("n", ["k32"], ["k16"])).drop("n")
             .join(middle.withColumn("b", _earlier("n", ["k48"], ["k32"])).drop("n"), ["g", "k32", "k48"])
             .join(top.withColumn("c", _earlier("n", [], ["k48"])).drop("n"), ["g", "k48"])
             .select("g", "k16", (F.col("a") + F.col("b") + F.col("c")).alias("ahead")))
    inside = words.withColumn("k16", F.shiftright("word", 10)).withColumn("inside", _earlier("n", ["k16"], ["word"]))
    return inside.join(ahead, ["g", "k16"]).withColumn("before", F.col("inside") + F.col("ahead")).drop("k16", "inside", "ahead")


def ranked(leaves: DataFrame) -> DataFrame:
    """A written table (g, doc_id, leaf, altered) -> runs of equal rows with their first ``rank`` and ``number``."""
    rows = leaves.withColumn("word", word_of(F.col("doc_id"))).withColumn("bit", F.expr("cast(doc_id & 63 as int)"))
    words = rows.groupBy("g", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n"))
    listed = materialize(directory(words).withColumn("single", F.coalesce(F.bit_count("bits") == F.col("n"), F.lit(False))), "directory")
    met = rows.join(listed, ["g", "word"])
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    one = met.filter("single").select("g", "doc_id", "leaf", "altered", (F.col("before") + below).alias("rank"), F.lit(1).cast("long").alias("number"))
    # words with repeated or null ids: ranges of digests inside a word, then digests inside a range
    runs = (met.filter("not single").withColumn("range", F.substring("leaf", 1, 4))
            .groupBy("g", "word", "before", "doc_id", "range", "leaf").agg(F.count(F.lit(1)).alias("n"), F.first("altered").alias("altered")))
    ranges = runs.groupBy("g", "word", "doc_id", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select(F.col("g").alias("g_"), F.col("word").alias("word_"), F.col("doc_id").alias("id_"), F.col("range").alias("range_"),
                           _earlier("n", ["word"], ["doc_id", "range"]).alias("ahead"))
    inside = runs.withColumn("inside", _earlier("n", ["word", "doc_id", "range"], ["leaf"]))
    many = (inside.join(ranges, (F.col("g") == F.col("g_")) & (F.col("word") == F.col("word_"))
                        & F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("range") == F.col("range_")))
            .select("g", "doc_id", "leaf", "altered", (F.col("before") + F.col("ahead") + F.col("inside")).alias("rank"),
                    F.col("n").alias("number")))
    return one.unionByName(many)


def ordered(groups: DataFrame) -> DataFrame:
    """(g, node) -> with ``rank``, g's place in byte order; sorted by range, numbered by slices."""
    place = F.monotonically_increasing_id()
    rows = materialize(groups.orderBy("g").withColumn("part", F.shiftright(place, 33)).withColumn("inside", place.bitwiseAND((1 << 33) - 1)), "groups")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row a partition
    starts = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    return rows.join(starts, "part").select("g", "node", (F.col("ahead") + F.col("inside")).alias("rank"))


def blocks(runs: DataFrame) -> DataFrame:
    """(g, rank, number, ...) -> one row a block: (g, block, entries), with the slots that each entry fills."""
    first, last = F.col("rank"), F.col("rank") + F.col("number") - 1
    start = F.shiftleft(F.col("block"), LEVELS)
    cut = runs.withColumn("block", F.explode(F.sequence(F.shiftright(first, LEVELS), F.shiftright(last, LEVELS))))
    cut = cut.withColumn("slot", F.greatest(first, start) - start).withColumn("fills", F.least(last, start + BLOCK - 1) - F.greatest(first, start) + 1)
    fields = [c for c in cut.columns if c not in ("g", "block", "rank", "number")]
    return cut.groupBy("g", "block").agg(F.collect_list(F.struct(*fields)).alias("entries"))


def slots(slot, fills, values) -> list:
    """The values in the order of their slots."""
    out = [None] * int(sum(fills))
    for a, n, v in zip(slot, fills, values):
        out[a:a + n] = [v] * n
    return out


def tree(block: int, nodes: list[str]) -> list[list[str]]:
    """The levels of a block, from its slots to its node.

    Places are gapless, so block 0 is a group's only one if it is not full; then it is reduced to one
    node. Any other block is reduced by ``LEVELS`` levels, a last run of one node at each included.
    """
    levels = [nodes]
    for _ in range(LEVELS if block else (len(nodes) - 1).bit_length()):
        now = levels[-1]
        levels.append([digest(now[i:i + 2]) for i in range(0, len(now), 2)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """Level by level, ``L`` or ``R`` (its side) and the sibling, or nothing where there is none."""
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append("" if j >= len(nodes) else ("L" if j < i else "R") + nodes[j])
        i >>= 1
    return out


def folded(node: str, path: list[str]) -> str:
    for x in path:
        node = digest([x[1:], node] if x.startswith("L") else [node, x[1:]])
    return node


def reduced(held: DataFrame, value: str) -> DataFrame:
    """Blocks -> the nodes above them, as runs of the next pass: (g, rank, number, node)."""
    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = [tree(b, slots(s, f, v))[-1][0] for b, s, f, v in zip(batch["block"], batch["slot"], batch["fills"], batch["value"])]
            yield pd.DataFrame({"g": batch["g"], "rank": batch["block"], "number": 1, "node": nodes})

    return (held.select("g", "block", F.col("entries.slot").alias("slot"), F.col("entries.fills").alias("fills"), F.col(f"entries.{value}").alias("value"))
            .mapInPandas(up, "g string, rank long, number long, node string"))


def passes(runs: DataFrame, value: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written block tables of every pass, lowest first, and each group's last node (g, node)."""
    tables = []
    while True:
        tables.append(materialize(blocks(runs), f"{name}-blocks"))
        runs, value = materialize(reduced(tables[-1], value if len(tables) == 1 else "node"), f"{name}-nodes"), "node"
        if not runs.filter("rank > 0").limit(1).collect():
            return tables, runs.select("g", "node")


def paths(held: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of a pass's nodes: (g, rank, node, path, subroot, root) from its blocks' own paths."""
    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                levels = tree(r.block, slots(r.slot, r.fills, r.value))
                found += [(r.g, r.block * BLOCK + i, node, siblings(levels, i) + list(r.path), r.subroot, r.root)
                          for i, node in enumerate(levels[0])]
            yield pd.DataFrame(found, columns=["g", "rank", "node", "path", "subroot", "root"])

    met = held.join(above.withColumnRenamed("rank", "block").drop("node"), ["g", "block"])
    return (met.select("g", "block", F.col("entries.slot").alias("slot"), F.col("entries.fills").alias("fills"),
                       F.col("entries.node").alias("value"), "path", "subroot", "root")
            .mapInPandas(down, "g string, rank long, node string, path array<string>, subroot string, root string"))


PROVEN = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean, lang string, place long")


def proven(held: DataFrame, above: DataFrame) -> DataFrame:
    """The lowest blocks and their paths -> one row a leaf with its proof, recomputed from ``altered`` if that is set."""
    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                order = slots(r.slot, r.fills, range(len(r.slot)))
                levels, path, found = tree(r.block, [r.leaf[k] for k in order]), list(r.path), []
                for i, k in enumerate(order):
                    whole = siblings(levels, i) + path
                    again = folded(r.altered[k] or r.leaf[k], whole)
                    found.append((r.doc_id[k], r.leaf[k], r.subroot, r.root, digest([x[1:] for x in whole]), again, again == r.root,
                                  r.g[1:] if r.g else None, r.block * BLOCK + i))
                out = pd.DataFrame(found, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lang", "place"])
                yield out.astype({"doc_id": "Int64"})

    met = held.join(above.withColumnRenamed("rank", "block").drop("node"), ["g", "block"])
    return (met.select("g", "block", *[F.col(f"entries.{c}").alias(c) for c in ("slot", "fills", "leaf", "altered")],
                       F.transform("entries", lambda e: e["doc_id"].cast("string")).alias("doc_id"), "path", "subroot", "root")
            .mapInPandas(down, PROVEN))


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """Leaf, subroot, root, proof and the root recomputed from ``altered`` (a leaf, or null) of every row."""
    altered = F.lit(None).cast("string") if altered is None else altered
    leaves = materialize(docs.select(group_key(F.col("lang")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
                                     leaf().alias("leaf"), altered.alias("altered")), "leaves")
    low, subroots = passes(ranked(leaves), "leaf", "rows")
    high, root = passes(ordered(subroots).select(F.lit("").alias("g"), "rank", F.lit(1).cast("long").alias("number"),
                                                 F.col("g").alias("name"), "node"), "node", "groups")
    # down from the root, whose path is empty
    above = root.select("g", F.lit(0).cast("long").alias("rank"), "node", F.array().cast("array<string>").alias("path"),
                        F.lit("").alias("subroot"), F.col("node").alias("root"))
    for held in reversed(high):
        above = paths(held, above)
    named = high[0].select("block", F.explode("entries").alias("e")).select(
        (F.col("block") * BLOCK + F.col("e.slot")).alias("rank"), F.col("e.name").alias("name"))
    above = above.join(named, "rank").select(F.col("name").alias("g"), F.lit(0).cast("long").alias("rank"), "node", "path",
                                             F.col("node").alias("subroot"), "root")
    for held in reversed(low[1:]):
        above = paths(held, above)
    return proven(low[0], above)


def op12_bitmap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; tampered where 7 divides the crc32 of the id: n_chars grows by 1."""
    docs = common.table(spark, sf_dir, "documents")
    tampered = F.when(common.crc_mod(F.col("doc_id"), 7) == 0, leaf(n_chars=F.expr("try_add(n_chars, 1)")))
    return manifest(docs, tampered)


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::varchar)::varchar || ':' || ({value})::varchar, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


def _levels_sql(source: str, key: str) -> str:
    """All levels of the trees over (key, i, h): the recursive term reduces the latest one."""
    return f"""(select {key}, 0 as lev, i, h from {source} union all
        select {key}, lev + 1, i // 2, sha256(string_agg(h, '' order by i))
        from (select *, count(*) over (partition by {key}) as n from {{name}}) where n > 1 group by {key}, lev, i // 2)"""


OP12_SQL = f"""
with recursive
d as (select *, case when doc_id is not null then list_reduce(
        flatten([[4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))]),
        lambda r, x: case when x >= 0 then xor(r, x) when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end) end as crc from documents),
l as (select lang is null as no_lang, coalesce(lang, '') as lang, doc_id, {_leaf_sql('n_chars')} as h,
             case when xor(crc, 4294967295) % 7 = 0 then {_leaf_sql('n_chars + 1')} end as altered from d),
p as (select *, row_number() over (partition by no_lang, lang order by doc_id nulls first, h) - 1 as i,
             dense_rank() over (order by no_lang desc, lang) - 1 as g from l),
t as {_levels_sql('p', 'g').format(name='t')},
s as (select g, arg_max(h, lev) as subroot, max(lev) as height from t group by g),
sub as (select 0 as all_, g as i, subroot as h from s),
u as {_levels_sql('sub', 'all_').format(name='u')},
r as (select arg_max(h, lev) as root, max(lev) as height from u),
steps as (
    select p.g, p.i, 0 as stage, k.lev, t.h, (p.i >> k.lev) & 1 = 1 as is_left from p
    join (select distinct g, lev from t) k on k.g = p.g join s on s.g = p.g and k.lev < s.height
    left join t on t.g = p.g and t.lev = k.lev and t.i = xor(p.i >> k.lev, 1)
    union all
    select p.g, p.i, 1, k.lev, u.h, (p.g >> k.lev) & 1 = 1 from p
    join (select distinct lev from u) k on true join r on k.lev < r.height
    left join u on u.lev = k.lev and u.i = xor(p.g >> k.lev, 1)),
w as (select g, i, list(coalesce(case when is_left then 'L' else 'R' end || h, '') order by stage, lev) as path from steps group by g, i),
f as (select p.*, s.subroot, r.root, coalesce(w.path, []) as path from p join s using (g) left join w using (g, i), r),
o as (select *, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) as proof_sha256,
             list_reduce(list_prepend(coalesce(altered, h), path), lambda a, x: case
                 when x = '' then sha256(a) when x[1] = 'L' then sha256(x[2:] || a) else sha256(a || x[2:]) end) as folded_root from f)
select doc_id, h as leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified,
       case when not no_lang then lang end as lang, i as place from o
"""
