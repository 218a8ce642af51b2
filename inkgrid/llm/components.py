"""Connected components by large-star and small-star steps, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.llm.common import cut, hot_join


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node that a path leads to.

    In turn, every node ties its larger neighbours to its least one (large star), then its smaller ones (small star). That
    never parts or joins components, and after a few rounds, of the order of the logarithm of the nodes, each component is a
    star around its least node. The centre of a large star is a hot key, which hot_join takes out of the shuffle. Loops,
    repeated edges and both directions are allowed; nulls are left out; no edges give no rows.
    """
    pairs = edges.filter("a is not null and b is not null").select("a", "b")
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = now.agg(F.count_if(F.col("a") != F.col("b")), F.bit_xor(F.xxhash64("a", "b")))
    before, left = None, state.first()
    loops = now.filter("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    now = now.filter("a <> b")
    while left[0] and left != before:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = hot_join(both.filter("b > a"), least, "a", "n", 2 * left[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, "a", "n", left[0]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, left = left, now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).union(loops).groupBy("node").agg(F.min("root").alias("root"))
