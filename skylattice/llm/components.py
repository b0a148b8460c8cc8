"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylattice.session import materialize


def _stored(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct pairs as a table, and a digest of its rows."""
    table = materialize(pairs.distinct())
    row = table.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return table, tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not the smallest of its component;
    root is the smallest. Nodes are longs; loops and repeated links are allowed.

    Each round points every node at its smallest neighbour, first among all larger neighbours,
    then among the smaller ones, until nothing changes; about the logarithm of the longest path.
    Minima are summed map-side and joined back, both sides read from tables, so that a node with
    very many links is split by adaptive execution."""
    pairs = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    pairs, state = _stored(pairs.where("hi > lo"))
    while state[0]:
        both = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(
            pairs.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        least = materialize(both.groupBy("node").agg(
            F.least("node", F.min("other")).alias("least")))
        large, _ = _stored(
            pairs.join(least, pairs["lo"] == least["node"])
            .select("hi", F.col("least").alias("lo")))
        least = materialize(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")))
        met = large.join(least, large["hi"] == least["node"])
        small = met.select(F.explode(F.array(
            F.struct(F.col("hi"), F.col("least").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("p")).select("p.*")
        pairs, after = _stored(small.where("hi > lo"))
        if after == state:
            break
        state = after
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
