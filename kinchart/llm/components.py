"""Connected components by alternating stars, as Spark joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinchart.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest of its neighbours and itself to its larger neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    sideways = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return sideways.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the edges (a, b): comp is the smallest node that can be reached.

    The edges become stars in a number of rounds that grows with the logarithm of the longest path.
    Nodes are joined by key and folded to minima before each shuffle; a node with very many
    neighbours is split by the skew join.
    """
    pairs = edges.where("a <> b").select("a", "b")
    if pairs.isEmpty():
        return pairs.toDF("node", "comp")
    before = None
    while True:
        pairs = stored(_small_star(_large_star(pairs).where("a <> b").distinct()).where("a <> b").distinct())
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node")).distinct()
    return stored(pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots.select("node", F.col("node").alias("comp"))))
