"""Trees of any depth from parent links, by pointer jumping.

In each round a node's pointer jumps to where its target points, so a path of d links
takes log2(d) joins.  Nodes that have found their root leave the join; what is left when
a round finds none hangs on a cycle.  A parent with most children is one row of the join's
right side, and its children are spread by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import folder


def _kept(df: DataFrame) -> DataFrame:
    """Written and read back: rounds build on it."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hierarchy(links: DataFrame, node: str = "node", parent: str = "parent", paths: bool = True) -> DataFrame:
    """(node, parent) to node, parent, root, depth, path and cycle.

    A root has a null parent; a parent that is no node of the table is a root as well,
    one link above its children.  ``path`` leads from the root to the node.  Nodes on a
    cycle or below one have cycle true and nulls.  Rows of a node that repeats count once,
    with its least parent, a real one before none; null nodes are left out.
    """
    kind = links.schema[node].dataType.simpleString()
    one = _kept(links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(F.col(parent).cast(kind)).alias("parent")))
    done = _kept(one.where("parent is null").select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth")))
    open_ = _kept(one.where("parent is not null").select("node", F.col("parent").alias("at"), F.lit(1).cast("bigint").alias("d")))
    while not open_.isEmpty():
        # Who has arrived still carries those behind to the root; a root, or what is no node, carries none.
        jump = open_.unionByName(done.where("depth > 0").select("node", F.col("root").alias("at"), F.col("depth").alias("d")))
        jump = jump.select(F.col("node").alias("at"), F.col("at").alias("__at"), F.col("d").alias("__d"))
        moved = _kept(open_.join(jump, "at", "left"))
        ended = moved.where("__at is null").select("node", F.col("at").alias("root"), F.col("d").alias("depth"))
        if ended.isEmpty():  # a deeper node would have an ancestor that ends in this round
            break
        done = done.unionByName(ended)
        open_ = moved.where("__at is not null").select("node", F.col("__at").alias("at"), (F.col("d") + F.col("__d")).alias("d"))
    done = _kept(done)
    found = one.join(done, "node", "left").withColumn("cycle", F.col("root").isNull())
    if not paths:
        return found.select("node", "parent", "root", "depth", "cycle")
    return found.join(_paths(done, one), "node", "left").select("node", "parent", "root", "depth", "path", "cycle")


def _paths(done: DataFrame, one: DataFrame) -> DataFrame:
    """The path of each node that has a root: pieces double in length, and those of cycles are never built."""
    live = done.join(one, "node").select("node", F.col("parent").alias("at"), F.array("node").alias("way"))
    outside = live.where("at is not null").join(one.select(F.col("node").alias("at")), "at", "left_anti").select("node")
    # A parent outside the table is the path's first node.
    live = live.join(outside.withColumn("__out", F.lit(True)), "node", "left")
    live = _kept(live.select("node", F.when(F.col("__out").isNull(), F.col("at")).alias("at"), F.when(F.col("__out"), F.concat(F.array("at"), "way")).otherwise(F.col("way")).alias("way")))
    while not live.where("at is not null").isEmpty():
        behind = live.select(F.col("node").alias("at"), F.col("at").alias("__at"), F.col("way").alias("__way"))
        moved = live.where("at is not null").join(behind, "at").select("node", F.col("__at").alias("at"), F.concat("__way", "way").alias("way"))
        live = _kept(live.where("at is null").unionByName(moved))
    return live.select("node", F.col("way").alias("path"))
