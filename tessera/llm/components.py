"""Connected components by alternating large and small stars.

Each round is two grouped minima and two joins on node, in which a node that holds
many rows (the middle of a star) is dealt out; nothing goes to the driver but numbers
that tell whether the links still change and how many rows a node holds at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT_SHARE, LEAST_HOT, discard, join_classes, materialize


def _met(rows: DataFrame, classes: DataFrame, many: int) -> DataFrame:
    """Inner join on u with a row (u, m, n) of each node, where n of the rows are the node's; no node is in one task with more than its share."""
    made = materialize(classes, "nodes", compact=True)
    most = made.agg(F.max("n")).head()[0] or 0
    # Where no node holds many rows, an ordinary join is one; both ways give the same rows.
    joined = rows.join(made, "u") if most <= max(many // HOT_SHARE, LEAST_HOT) else join_classes(rows, made, "u", "n", many)
    return joined.drop("n")


def _stars(links: DataFrame, many: int) -> DataFrame:
    """One round over ``many`` links (u, v), u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    large = _met(both, least, 2 * many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = materialize(large, "large", compact=True)
    roots = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _met(large, roots, many).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the pairs (a, b); the label is the least node reachable.

    A pair of equal nodes adds nothing; an empty table gives an empty result.
    """
    links = pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    digest = lambda t: t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head()
    links = materialize(links, "links", compact=True)
    was = digest(links)
    while was[0]:
        last, links = links, materialize(_stars(links, was[0]), "links", compact=True)
        discard(last)
        now = digest(links)
        if now == was:
            break
        was = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
