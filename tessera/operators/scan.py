"""State machines over ordered rows, run as a distributed scan.

A row is a transition: for each state the next one.  Transitions compose, so a group
of any length may lie over many partitions: each partition follows every state that
its first group may be in, and one row a partition (its first and last group and what
the last one's transitions come to) tells the others where to begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tessera.sources.scratch import folder


def _follow(states: int):
    """Adds ``__before``: the state before each row; for the partition's first group by each state that it may begin in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, group, now, at = TaskContext.get().partitionId(), True, None, np.arange(states), 0
        for batch in batches:
            groups = batch.column("__group").to_pylist()
            steps = batch.column("__next").flatten().to_numpy(zero_copy_only=False).reshape(-1, states)
            before = []
            for g, step in zip(groups, steps, strict=True):
                if g != group:
                    first = first and group is None
                    group, now = g, np.arange(states) if first else np.zeros(1, np.int64)
                before.append(now.tolist())
                now = step[now]
            own = pa.array(before, pa.list_(pa.int32()))
            places = pa.array(np.arange(at, at + len(groups)))
            at += len(groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, own, pa.array(np.full(len(groups), part, np.int32)), places], [*batch.schema.names, "__before", "__part", "__at"])

    return run


def states_before(rows: DataFrame, group: list[str], order: list[str], transition: Column, states: int) -> DataFrame:
    """``rows`` with ``state``: that of its group before each row, from 0 at its begin.

    ``transition`` is an array of ``states`` ints over the rows' columns: the next state
    by state.  Rows that ``order`` doesn't tell apart are taken in the order of a hash of
    their columns, which can't be maps.  Null is a group of its own; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    marked = rows.select(F.struct("*").alias("__row"), F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("__group"), F.struct(*order).alias("__order"), transition.cast("array<int>").alias("__next"))
    marked = marked.withColumn("__tie", F.xxhash64("__row"))
    keys = ["__group", "__order", "__tie"]
    ranged = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__order", "__tie")
    schema = StructType([*ranged.schema.fields, StructField("__before", ArrayType(IntegerType())), StructField("__part", IntegerType()), StructField("__at", LongType())])
    path = folder(spark)
    ranged.mapInArrow(_follow(states), schema).write.parquet(path)
    table = spark.read.schema(schema).parquet(path)

    # One row a partition.
    last = F.max_by(F.struct("__group", "__next", "__before"), "__at")
    parts = table.groupBy("__part").agg(F.min_by("__group", "__at").alias("first"), last.alias("last")).orderBy("__part").collect()
    begins, group_now, state = [], None, 0
    for p in parts:
        begin = state if p["first"] == group_now else 0
        begins.append((p["__part"], begin))
        before = p["last"]["__before"]
        group_now, state = p["last"]["__group"], p["last"]["__next"][before[begin if len(before) > 1 else 0]]
    known = spark.createDataFrame(begins, "__part int, __begin int")
    found = F.element_at("__before", F.when(F.size("__before") > 1, F.col("__begin") + 1).otherwise(1))
    return table.join(F.broadcast(known), "__part").select("__row.*", found.alias("state"))
