"""Near-duplicate documents by MinHash: a signature-coordinate inverted join.

A document's set is its distinct word shingles. Its signature has ``COORDINATES`` minima;
two sets of Jaccard similarity J agree in each coordinate with probability J. Steps:

1. Signatures, one pass over the texts. Documents of equal sets are collapsed into one
   class (a digest of the set, combined map-side), so copies never meet again.
2. Every class is posted under each (coordinate, value) token. Tokens of a single class can
   match nothing and are dropped after counting; a class left with fewer than ``MATCHES``
   shared tokens cannot reach the threshold and goes too.
3. Prefix and skip merging: with tokens in one global order (rarest first), two classes
   that agree in at least ``MATCHES`` tokens share one among their first
   m - MATCHES + 1, m being the tokens a class has left. Only those prefixes are joined,
   so the values that very many documents share are merged last or never.
4. Round one ties each class to one centre: of the smallest classes in its prefix lists,
   the one with most agreeing tokens. Pairs that collide at least ``MATCHES`` times are confirmed on
   the full sets; components are formed. So a group of thousands of near copies costs a
   pair per member, not a pair per two members.
5. Round two merges the prefix lists for what round one left: pairs whose classes are still
   in different components (a pair inside one cannot change the result). Lists meet block by
   block inside tasks, where collisions are counted on the signatures; what leaves is a
   forest that ties together the classes with any pair at or over ``MATCHES``, never the
   pairs. Each tree is a cluster of suspects.
6. Inside each cluster all pairs of different components are confirmed on the full sets,
   again block by block in tasks (intersections of a block pair are one matrix product), and a forest of the
   links leaves. After this no pair of ``MATCHES`` collisions is unchecked or unconnected.

The only loss is a pair of J >= 0.75 with fewer than ``MATCHES`` = 26 of 64 agreeing
coordinates: a binomial tail of about 1e-9 for each link.

Defined results: no text, or no word, is the empty set, linked with nothing; fewer words
than ``SHINGLE`` are one shingle. Repeated ids are one document for linking (their rows
remain in a filter): each different text has a class of its own, found and confirmed by that text,
and the classes of an id are tied when the components are formed. A class goes by its smallest
id; where that id has several classes, all but one go by a 64-bit hash of the set's digest instead.
Rows with a null id link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.llm import common
from riskflow.llm.components import components
from riskflow.operators.materialize import materialize

SHINGLE = 5
COORDINATES = 64
MATCHES = 26
PERCENT = 75
WORD_MEMO = 300_000

_WORDS: dict[bytes, int] = {}
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    memo = _WORDS
    if len(memo) > WORD_MEMO:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = xxh3_64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _forget() -> bool:
    held = bool(_WORDS)
    _WORDS.clear()
    return held


common.remembers(__name__, _forget)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the whole text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        out = _mix(out * _MULTIPLY + h[k:k + n])
    return np.unique(out)


def signature(found: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The least value of each of ``coordinates`` mixings of the set, as tokens that carry
    the coordinate."""
    seeds = _mix(np.arange(1, coordinates + 1, dtype=np.uint64) * _MULTIPLY)
    out = np.empty(coordinates, np.uint64)
    for i, seed in enumerate(seeds):
        out[i] = ((found ^ seed) * (seed | np.uint64(1))).min()
    return _mix(out ^ seeds)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, digest of the set, signature tokens) for every row; the mark tells
    the texts of one id apart."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b
        common.forget(but=__name__)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text)
                rows.append((len(s), blake2b(s.tobytes(), digest_size=16).digest(),
                             signature(s).view(np.int64)) if len(s) else (0, None, None))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "mark": batch["mark"],
                                "n_shingles": [r[0] for r in rows],
                                "digest": [r[1] for r in rows], "tokens": [r[2] for r in rows]})

    return (docs.withColumn("mark", F.xxhash64("text"))
            .mapInPandas(sign, "doc_id long, mark long, n_shingles long, digest binary, tokens array<long>"))


def _texts(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text), once each, for the (doc_id, mark) in ``needed``."""
    return (docs.withColumn("mark", F.xxhash64("text")).join(needed, ["doc_id", "mark"], "left_semi")
            .groupBy("doc_id", "mark").agg(F.min("text").alias("text")))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those (a, b) whose full sets have PERCENT of their union in common.

    Only texts of classes in ``pairs`` are read again and travel; each pair meets the two
    texts in two joins on the texts' ids and marks, whose large partitions Spark can split.
    """
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(x), F.col("doc_id").alias(f"doc_{x}"),
                                          F.col("mark").alias(f"mark_{x}")), x)
    needed = pairs.select(F.explode(F.array(*[F.struct(F.col(f"doc_{x}").alias("doc_id"), F.col(f"mark_{x}").alias("mark"))
                                              for x in "ab"])).alias("t")).select("t.*").distinct()
    texts, both = _texts(needed, docs), pairs
    for x in "ba":
        both = both.join(texts.select(F.col("doc_id").alias(f"doc_{x}"), F.col("mark").alias(f"mark_{x}"),
                                      F.col("text").alias(f"text_{x}")), [f"doc_{x}", f"mark_{x}"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.forget(but=__name__)
        text, left = None, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (ta, tb) in enumerate(zip(batch["text_a"], batch["text_b"])):
                if text is None or ta != text:
                    text, left = ta, shingles(ta)
                right = shingles(tb)
                common_ = len(np.intersect1d(left, right, assume_unique=True))
                keep[i] = 100 * common_ >= PERCENT * (len(left) + len(right) - common_)
            yield batch.loc[keep, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def agreeing(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds ``hits``, the tokens that the two classes of a pair have in common."""
    return (pairs.join(lists.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a")), "a")
            .join(lists.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b")), "b")
            .select("a", "b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("hits")))


def _in_blocks(members: DataFrame, key: str, size: int) -> DataFrame:
    """Deal the rows of each ``key`` into blocks of about ``size`` by a hash of the node, and send
    block b to every pair of blocks that it is in: adds block, b0, b1."""
    sizes = (members.groupBy(key).count().filter("count > 1")
             .select(key, F.ceil(F.col("count") / F.lit(size)).cast("int").alias("blocks")))
    dealt = (members.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return dealt.withColumns({"b0": F.least("block", "other"), "b1": F.greatest("block", "other")}).drop("blocks", "other")


def _each_group(columns: list[str], work):
    """A mapInPandas function that calls ``work`` on complete runs of equal ``columns``; several
    runs may come in one call, one run never in two."""
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            last = (batch[columns] == batch[columns].iloc[-1]).all(axis=1).to_numpy()
            if held and not (held[-1][columns].iloc[-1] == batch[columns].iloc[0]).all():
                yield work(pd.concat(held, ignore_index=True))
                held = []
            if last.all():
                held.append(batch)
                continue
            yield work(pd.concat([*held, batch[~last]], ignore_index=True))
            held = [batch[last]]
        if held:
            yield work(pd.concat(held, ignore_index=True))
    return stream


def _groups(rows: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each run of equal ``columns``."""
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = np.logical_or.reduce([rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1] for c in columns])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(rows)))


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Edges (a, b) of a star forest over the pairs of row numbers."""
    _, row = np.unique(nodes, return_inverse=True)
    names = np.zeros(row.max() + 1 if len(row) else 0, np.int64)
    names[row] = nodes
    i, j = row[i], row[j]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    tied = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"a": names[root[tied]], "b": names[tied]})


LIST_BLOCK = 1000
SET_BLOCK = 256


def _suspects(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """A forest (a, b) over the classes with a pair of >= MATCHES collisions across components,
    from the merged lists (token, node, label)."""
    columns = ["token", "b0", "b1"]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.stack(rows["marks"].to_numpy()).astype(np.int32)
        label, block = rows["label"].to_numpy(), rows["block"].to_numpy()
        across = (rows["b0"] != rows["b1"]).to_numpy()
        first, size = _groups(rows, columns)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in _row_pairs(first, size, 50_000):
            met = (label[i] != label[j]) & (~across[i] | (block[i] != block[j]))
            i, j = i[met], j[met]
            hit = np.count_nonzero(marks[i] == marks[j], axis=1) >= MATCHES
            if hit.any():
                found.append((i[hit], j[hit]))
        if not found:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        return _forest(rows["node"].to_numpy(), *(np.concatenate(x) for x in zip(*found)))

    spark = open_.sparkSession
    # 32 bits of each coordinate's token are enough to count collisions: chance ones only add suspects.
    marks = nodes.select("node", F.transform("tokens", lambda t: F.shiftright(t, 32).cast("int")).alias("marks"))
    rows = _in_blocks(open_, "token", LIST_BLOCK).join(marks, "node")
    return (rows.repartition(common.shuffle_partitions(spark), *columns).sortWithinPartitions(*columns, "node")
            .mapInPandas(_each_group(columns, merge), "a long, b long"))


def _row_pairs(first: np.ndarray, size: np.ndarray, most: int):
    """(i, j) of all row pairs i < j inside groups, about ``most`` pairs at a time."""
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row, partners = np.repeat(first, size) + inside, np.repeat(size, size) - 1 - inside
    ends, a = np.cumsum(partners), 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        n = partners[a:b]
        i = np.repeat(row[a:b], n)
        yield i, i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = b


def _intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over shared elements."""
    sizes = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[element] > 1
    number = np.cumsum(count > 1) - 1
    owner, element = owner[shared], number[element[shared]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(element[-1]) + 1 if len(element) else 0, columns):
        lo, hi = np.searchsorted(element, [a, a + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[lo:hi], element[lo:hi] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _linked(members: DataFrame, docs: DataFrame) -> DataFrame:
    """A forest (a, b) over the links between components, from clusters (component, node, label, doc_id, mark)."""
    columns = ["component", "b0", "b1"]

    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        label, block = rows["label"].to_numpy(), rows["block"].to_numpy()
        across = (rows["b0"] != rows["b1"]).to_numpy()
        sets = [shingles(t) for t in rows["text"]]
        found_i, found_j = [], []
        for a, n in zip(*(x.tolist() for x in _groups(rows, columns))):
            if n == 2:
                both = np.array([[0, len(np.intersect1d(*sets[a:a + 2], assume_unique=True))], [0, 0]])
            else:
                both = _intersections(sets[a:a + n])
            i, j = np.triu_indices(n, 1)
            size = np.array([len(s) for s in sets[a:a + n]])
            c = both[i, j]
            ok = 100 * c >= PERCENT * (size[i] + size[j] - c)
            i, j = i[ok] + a, j[ok] + a
            ok = (label[i] != label[j]) & (~across[i] | (block[i] != block[j]))
            found_i.append(i[ok])
            found_j.append(j[ok])
        return _forest(rows["node"].to_numpy(), np.concatenate(found_i), np.concatenate(found_j))

    spark = docs.sparkSession
    texts = _texts(members.select("doc_id", "mark"), docs)
    rows = _in_blocks(members, "component", SET_BLOCK).join(texts, ["doc_id", "mark"])
    return (rows.repartition(common.shuffle_partitions(spark), *columns).sortWithinPartitions(*columns, "node")
            .mapInPandas(_each_group(columns, confirm), "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
    docs = common.id_and_text(docs)
    signed = materialize(signatures(docs), "signatures")
    usable = signed.filter("digest is not null and doc_id is not null")
    repeated = materialize(signed.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"),
                           "repeated")
    again = not repeated.isEmpty()
    # One class per distinct set, found by its smallest id and text.
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("of")).select("digest", "of.*")
    if again:                                      # the smallest id of several classes names only one
        named = classes.groupBy("doc_id").agg(F.min("digest").alias("first"))
        classes = (classes.join(named, "doc_id")
                   .withColumn("node", F.when(F.col("digest") == F.col("first"), F.col("doc_id")).otherwise(F.xxhash64("digest")))
                   .drop("first"))
    else:
        classes = classes.withColumn("node", F.col("doc_id"))
    classes = materialize(classes, "classes")
    nodes = (usable.join(classes.select("digest", "node", F.col("doc_id").alias("d"), F.col("mark").alias("m")), "digest")
             .filter("doc_id = d and mark = m").select("node", "tokens").dropDuplicates(["node"]))
    postings = materialize(nodes.select("node", F.explode("tokens").alias("token")), "postings")
    shared = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    lists = materialize(
        postings.join(shared, "token").groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
        .filter(F.size("t") >= MATCHES)
        .select("node", F.col("t.token").alias("tokens")), "token-lists")
    prefixes = lists.select("node", F.explode(F.expr(f"slice(tokens, 1, size(tokens) - {MATCHES} + 1)")).alias("token"))

    # Round one: the centre of each class.
    centres = prefixes.groupBy("token").agg(F.min("node").alias("a"))
    stars = (prefixes.join(centres, "token").filter("a <> node")
             .select("a", F.col("node").alias("b")).distinct())
    best = (agreeing(stars, lists).filter(F.col("hits") >= MATCHES).groupBy("b")
            .agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a")).select("a", "b"))
    first = materialize(confirmed(materialize(best, "stars"), classes, docs), "links")
    tied = components(first)

    # Round two: whatever else the lists hold across components.
    label = materialize(prefixes.join(tied, "node", "left")
                        .select("node", "token", F.coalesce("component", "node").alias("label")), "labelled")
    mixed = label.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1")
    open_ = label.join(mixed.select("token"), "token", "left_semi")
    names = label.select("node", "label").distinct()
    suspects = materialize(_suspects(open_, nodes), "suspects")
    clusters = components(suspects)
    second = materialize(_linked(clusters.join(names, "node").join(classes.drop("digest"), "node"), docs), "links")
    links = first.union(second)
    if again:                                      # from classes to ids, and an id to all of its classes
        for x in "ab":
            links = (links.join(classes.select(F.col("node").alias(x), F.col("doc_id").alias("of")), x)
                     .drop(x).withColumnRenamed("of", x))
        own = (usable.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), "digest")
               .join(classes.select("digest", F.col("doc_id").alias("b")), "digest").select("a", "b"))
        links = links.select("a", "b").union(own)
    joined = components(links)

    of_class = (classes.select("digest", F.col("doc_id").alias("node")).join(joined, "node", "left")
                .select("digest", F.coalesce("component", "node").alias("component_id")))
    found = signed.join(of_class, "digest", "left")
    if again:                                      # a row without words goes with its id's other texts
        found = (found.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                 .withColumn("component_id", F.coalesce("component_id", "component")))
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; one row per document with its component."""
    docs = common.id_and_text(common.table(spark, sf_dir, "documents"))
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP10_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
      from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
reach(a, b) as (select doc_id, doc_id from documents union select reach.a, l.b from reach join l on reach.b = l.a)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(reach.b) as component_id, d.doc_id = min(reach.b) as kept
from documents d join reach on reach.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""
