"""Document fingerprints as invertible Bloom lookup sketches of paragraphs, in DataFrame functions.

A text's paragraphs are its lines, cut after sentence ends, without repeats; one of more than
``LONG`` code points is cut further after each word whose hash is a multiple of ``SPREAD`` (so equal
passages are cut alike wherever they stand), white space in it counting as one blank. Each has a 64-bit digest. A sketch has three subtables; a digest goes to one cell of each, and a cell
holds the number of its digests and the xor of the digests and of their check hashes.
Subtracting two sketches leaves only the digests in which they differ; peeling recovers
them: a cell with count 1 or -1 whose check hash fits its digest is pure, its digest is taken
out of all its cells, and so on. If cells remain after ``ROUNDS`` rounds, the pair is tried again
with larger sketches (sized by the two texts' paragraphs, doubling) and other hashes, until
every difference is recovered.

The fingerprint is the text's sketch of ``BASE`` cells a subtable; the likeness of two texts
is the Jaccard similarity of their paragraph sets, from the recovered difference.

Layout: ids are split into ranges at ids that lie on range borders (a sorted pass over ids
alone); every document goes to its range, and a range's first document also to the range
before, where it follows the last. So one shuffle of the texts gives each document its
successor. A range is cut into blocks of ``BLOCK`` consecutive rows; the digests are shuffled once
more, by block, into a table bucketed by it, and sketching, subtracting and peeling are aggregates
inside a bucket, without a further shuffle. A range may grow (its rows pass through a sorted
window that spills), a block may not.

Defined results: null text is empty; an empty text has no paragraph; two empty texts have
likeness 1, an empty and another 0; the last document's next is the first (itself, if it is
the only one); a null id sorts first; rows of equal id follow each other by text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskflow.llm import common
from riskflow.operators.materialize import materialize, scratch_folder

BASE = 8
ROUNDS = 6
#: Documents in a range, about, while there are fewer than RANGES of them.
DOCUMENTS = 400
#: Largest number of ranges and buckets, which bounds the borders that the driver sees.
RANGES = 100_000
#: Rows in a block: what a join by block gathers in one row.
BLOCK = 1_000
LEAST = -(1 << 63)

PARAGRAPH = r"\n+|(?<=[.!?])\s+|(?<=[。！？])"
#: A paragraph of more code points is cut after words whose hash is a multiple of SPREAD.
LONG, SPREAD = 400, 16


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text, in order of first appearance."""
    def cut(p: Column) -> Column:
        marked = F.transform(F.split(p, r"\s+", -1), lambda w: F.when(
            F.pmod(F.xxhash64(w), F.lit(SPREAD)) == 0, F.concat(w, F.lit("\n"))).otherwise(w))
        return F.split(F.array_join(marked, " "), r"\n", -1)

    pieces = F.transform(F.split(text, PARAGRAPH, -1), lambda p: F.when(F.length(p) > LONG, cut(p)).otherwise(F.array(p)))
    parts = F.array_remove(F.transform(F.flatten(pieces), lambda p: F.trim(p)), "")
    return F.transform(F.array_distinct(parts), lambda p: F.xxhash64(p))


def range_count(docs: DataFrame) -> int:
    """Ranges of about DOCUMENTS, at least as many as shuffle partitions and at most RANGES (then larger ones)."""
    return max(common.shuffle_partitions(docs.sparkSession), min(RANGES, -(-docs.count() // DOCUMENTS)))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, row, doc_id, text, next_text) of (doc_id, text): each document with its successor.

    The rows come hash-partitioned by range into ``ranges`` partitions."""
    order = F.coalesce("doc_id", F.lit(LEAST))
    firsts = (docs.select(order.alias("o")).repartitionByRange(ranges, "o")
              .groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o")).collect())
    borders = sorted(r["o"] for r in firsts) or [LEAST]
    n = len(borders)
    steps = max(1, (n - 1).bit_length() + 1)
    listed = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<long>")      # folded to one literal
    # Binary search for the last border that is not above the id.
    at = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")),
        lambda s, _: F.when(s["hi"] - s["lo"] <= 1, s).when(
            F.get(listed, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= F.col("o"),
            F.struct(F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))),
        lambda s: s["lo"])
    placed = docs.select("doc_id", "text", order.alias("o")).withColumn("range", at)
    border = F.get(listed, F.col("range")) == F.col("o")
    copies = F.when(border, F.array(F.struct("range", F.lit(False).alias("guest")),
                                    F.struct(F.pmod(F.col("range") - 1, F.lit(n)).alias("range"), F.lit(True).alias("guest")))
                    ).otherwise(F.array(F.struct("range", F.lit(False).alias("guest"))))
    sent = (placed.withColumn("c", F.explode(copies))
            .select("doc_id", "text", "o", F.col("c.range").alias("range"), F.col("c.guest").alias("guest"))
            .repartition(ranges, "range"))
    here = Window.partitionBy("range").orderBy("guest", "o", "text")
    return (sent.withColumns({"next_text": F.lead("text").over(here), "row": F.row_number().over(here)})
            .filter(~F.col("guest")).select("range", "row", "doc_id", "text", "next_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def _cells(size: Column, attempt: int) -> Column:
    """The three cells of a digest ``d`` in subtables of ``size`` cells; cell -1 for a null one."""
    cells = F.array(*[F.lit(j) * size + F.pmod(F.xxhash64(F.col("d"), F.lit(1000 * attempt + j)), size) for j in range(3)])
    return F.when(F.col("d").isNotNull(), cells).otherwise(F.array(F.lit(-1).cast("long")))


def _check(d: str) -> Column:
    return F.xxhash64(F.lit("check"), F.col(d))


def _sketch(rows: DataFrame, keys: list[str], size: Column, attempt: int) -> DataFrame:
    """Cells (count, key, chk) of signed digests (d, sign) by ``keys``."""
    return (rows.withColumn("cell", F.explode(_cells(size, attempt))).groupBy(*keys, "cell")
            .agg(F.sum("sign").alias("count"), F.expr("bit_xor(d)").alias("key"),
                 F.expr("bit_xor(chk)").alias("chk")))


def _peel(cells: DataFrame, keys: list[str], attempt: int) -> DataFrame:
    """(keys, left, differing): cells that remain and digests recovered, from a difference of sketches.

    Cell -1 carries the number recovered so far. A round gives every pure cell's digest to its
    three cells and to cell -1, once (a digest may be pure in several), and sums.
    """
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    now = cells.withColumn("found", zero)
    for _ in range(ROUNDS):
        pure = (F.col("cell") >= 0) & (F.abs("count") == 1) & (F.col("chk") == _check("key"))
        own = F.struct(F.col("cell").alias("cell"), none.alias("tag"), F.col("count").alias("count"), F.col("key").alias("key"),
                       F.col("chk").alias("chk"), F.col("found").alias("found"))
        minus = [F.struct((F.lit(j) * F.col("size") + F.pmod(F.xxhash64(F.col("key"), F.lit(1000 * attempt + j)), F.col("size"))).alias("cell"),
                          F.col("key").alias("tag"), (-F.col("count")).alias("count"), F.col("key").alias("key"),
                          F.col("chk").alias("chk"), zero.alias("found")) for j in range(3)]
        noted = F.struct(F.lit(-1).cast("long").alias("cell"), F.col("key").alias("tag"), zero.alias("count"),
                         zero.alias("key"), zero.alias("chk"), F.lit(1).cast("long").alias("found"))
        spread = now.withColumn("e", F.explode(F.when(pure, F.array(own, *minus, noted)).otherwise(F.array(own))))
        once = (spread.select(*keys, "size", "e.*").groupBy(*keys, "size", "cell", "tag")
                .agg(F.max("count").alias("count"), F.max("key").alias("key"), F.max("chk").alias("chk"), F.max("found").alias("found")))
        now = (once.groupBy(*keys, "size", "cell")
               .agg(F.sum("count").alias("count"), F.expr("bit_xor(key)").alias("key"), F.expr("bit_xor(chk)").alias("chk"),
                    F.sum("found").alias("found"))
               .filter("cell < 0 or count <> 0 or key <> 0"))
    return now.groupBy(*keys).agg(F.sum(F.when(F.col("cell") >= 0, 1).otherwise(0)).alias("left"),
                                  F.sum("found").alias("differing"))


def differences(table: DataFrame) -> DataFrame:
    """(range, row, pair, differing): how many digests tell apart the text from its edited version
    (pair 1) and from the next text (pair 2), recovered by peeling, retrying larger on failure."""
    keys = ["range", "row", "pair"]
    sizes = {1: "edited_digests", 2: "next_digests"}
    done, pending, attempt = [], None, 0
    while True:
        pairs = F.array(*[F.struct(F.lit(p).alias("pair"), F.col("digests").alias("a"), F.col(c).alias("b"))
                          for p, c in sizes.items()])
        rows = table if pending is None else table.join(pending, "range")
        rows = (rows.select("*", F.explode(pairs).alias("p"))
                .filter(F.lit(True) if pending is None else F.array_contains("failed", F.col("row") * 4 + F.col("p.pair")))
                .select("range", "row", "p.*"))
        need = 0.6 * 2 ** (attempt - 1) * (F.size("a") + F.size("b"))
        size = F.lit(BASE) if attempt == 0 else F.greatest(
            F.lit(BASE), F.pow(F.lit(2), F.ceil(F.log2(need + 1))).cast("int"))
        signed = F.concat(F.transform("a", lambda d: F.struct(d.alias("d"), F.lit(1).alias("sign"))),
                          F.transform("b", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("sign"))),
                          F.array(F.struct(F.lit(None).cast("long").alias("d"), F.lit(0).alias("sign"))))
        listed = (rows.withColumn("size", size.cast("long")).select(*keys, "size", F.explode(signed).alias("s"))
                  .select(*keys, "size", "s.d", "s.sign").withColumn("chk", F.when(F.col("d").isNotNull(), _check("d"))))
        # The null digest puts a pair's cell -1 there from the start, so that a pair whose cells
        # all cancel out still has a row.
        cells = _sketch(listed, [*keys, "size"], F.col("size"), attempt)
        cells = cells.select(*keys, "size", "cell", "count", F.coalesce("key", F.lit(0).cast("long")).alias("key"),
                             F.coalesce("chk", F.lit(0).cast("long")).alias("chk"))
        result = materialize(_peel(cells, keys, attempt), f"peeled-{attempt}")
        done.append(result.filter("left = 0").select(*keys, "differing"))
        failed = result.filter("left > 0")
        if failed.isEmpty():
            break
        pending = failed.groupBy("range").agg(F.collect_list(F.col("row") * 4 + F.col("pair")).alias("failed"))
        attempt += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def fingerprints(table: DataFrame) -> DataFrame:
    """(range, row, fingerprint, edited_fingerprint): the base sketches, nonzero cells in order."""
    sets = F.array(F.struct(F.lit(0).alias("version"), F.col("digests").alias("d")),
                   F.struct(F.lit(1).alias("version"), F.col("edited_digests").alias("d")))
    rows = (table.select("range", "row", F.explode(sets).alias("s"))
            .select("range", "row", "s.version", F.explode("s.d").alias("d"))
            .withColumns({"sign": F.lit(1), "chk": _check("d")}))
    cells = _sketch(rows, ["range", "row", "version"], F.lit(BASE).cast("long"), 0)
    shown = F.concat_ws(":", F.col("cell").cast("string"), F.col("count").cast("string"), F.hex("key"), F.hex("chk"))
    cell = F.struct(F.col("cell").alias("cell"), shown.alias("shown"))
    text = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("version") == v, cell))),
                                              lambda c: c["shown"]), " ")
    return cells.groupBy("range", "row").agg(text(0).alias("fingerprint"), text(1).alias("edited_fingerprint"))


def _by_range(rows: DataFrame, name: str, *values: str) -> DataFrame:
    """One map row -> values for each block (at most BLOCK): joined on the block alone, it leaves the table where it is."""
    return rows.groupBy("range").agg(F.map_from_entries(F.collect_list(F.struct("row", F.struct(*values)))).alias(name))


def compare(docs: DataFrame) -> DataFrame:
    """One row per (doc_id, text): its and its edited version's fingerprints and likenesses."""
    docs, spark = common.id_and_text(docs), docs.sparkSession
    changed = edited(F.col("text"), F.col("next_text"))
    ranges = range_count(docs)
    block = F.shiftleft(F.col("range").cast("long"), 32) + F.floor((F.col("row") - 1) / BLOCK)
    rows = with_next(docs, ranges).withColumn("edited", changed).select(
        block.alias("range"), "row", "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"), digests(F.col("text")).alias("digests"),
        digests(F.col("edited")).alias("edited_digests"), digests(F.col("next_text")).alias("next_digests"))
    name = f"riskflow_paragraphs_{uuid.uuid4().hex}"
    (rows.repartition(ranges, "range").write.bucketBy(ranges, "range")
     .option("path", scratch_folder(spark, "paragraphs")).saveAsTable(name))
    table = spark.read.table(name)
    wide = differences(table).groupBy("range", "row").agg(
        F.max(F.when(F.col("pair") == 1, F.col("differing"))).alias("d1"), F.max(F.when(F.col("pair") == 2, F.col("differing"))).alias("d2"))

    def likeness(other: str, differing: str) -> Column:
        both, d = F.size("digests") + F.size(other), F.col(f"w.{differing}")
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))

    printed = fingerprints(table)
    joined = (table.join(_by_range(wide, "wide", "d1", "d2"), "range")
              .join(_by_range(printed, "printed", "fingerprint", "edited_fingerprint"), "range", "left")
              .withColumns({"w": F.element_at("wide", F.col("row")), "p": F.try_element_at("printed", F.col("row"))}))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("p.fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("p.edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        likeness("edited_digests", "d1").alias("near_edited"), likeness("next_digests", "d2").alias("near_next"),
        F.size("digests").cast("long").alias("n_paragraphs"))


def op1_paragraph_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; one row per document."""
    return compare(common.id_and_text(common.table(spark, sf_dir, "documents")))
