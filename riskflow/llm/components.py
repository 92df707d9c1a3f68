"""Connected components of an edge table by alternating star contractions.

Every round is joins and min-aggregates over the edges (Kiveris et al., "Connected
Components in MapReduce and Beyond"): the large star ties each node's larger neighbours to
the smallest node around it, the small star does so for its smaller neighbours. A node of
very many edges is never brought together: its minimum is combined map-side and joined back
to its edges, a join whose large partitions Spark can split. Rounds are cut by a written
table in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskflow.operators.materialize import materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
                        ).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    sides = _both(edges)
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (sides.filter("v > u").join(least, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    tied = sides.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return tied.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; the component is its smallest node.

    ``edges`` may hold loops, repeats and both directions. Nodes without an edge to another
    node are not returned: their component is themselves.
    """
    now = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        now = materialize(_small_star(_large_star(now)), "stars")
        # A star forest is a fixed point: the same edges come out of a further round.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
                    .union(now.select("b", "b")).distinct())
        before = tuple(state)
