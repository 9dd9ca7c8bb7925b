"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges are a DataFrame throughout; each round is two grouped minima with map-side combining, and is
written to shared storage, so lineage stays short and a lost executor costs one round at most.  The
joins with the minima are inner sort-merge joins whose result is dealt anew, so adaptive execution
splits the edges of a hub over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node with an edge to another, and the least node of its component.

    edges: columns a and b of one integer type, in any direction, repeats and loops allowed.  The
    least node of a component gets no row.
    """
    edges = cut(small_star(edges.where("a <> b").select("a", "b")))
    before = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")).first()
        if seen == before or not seen[0]:
            return edges
        before = seen
        edges = cut(small_star(large_star(edges)))
