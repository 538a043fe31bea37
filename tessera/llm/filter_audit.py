"""Operator 13: how the filters of a cleaning pipeline act together, in every order.

Each document gets a bit for each filter that it fails.  These flags are crossed with
all orders of the filters (a broadcast of n! rows, 120 for five filters), each pair is
exploded into the order's steps, the first failure says at which step the document
goes, and one conditional aggregation with map-side combining counts what each step
keeps and removes.  Every document is replayed through every order; none is sampled.

Null text counts as empty, a null part as ``''``.  Repeated rows are separate
documents.  Of texts that are identical (by SHA-256) all but those with the smallest
doc_id fail filter E; a null doc_id is smaller than none and fails it never.  Labels
that repeat a doc_id count as 1 if any of them is 1; without a label, as in an empty
label table, a document is neither good nor toxic.  Texts of any length are read
whole.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_classes, materialize

#: Documents that a task replays; tasks of the replay at most.
ROWS_A_TASK, MOST_TASKS = 1 << 13, 1 << 15
#: Filters that may be audited together: 720 orders at most are broadcast.
MOST_FILTERS = 6


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters A to D: under 100 words, repeated words, capitals, and odd signs."""
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def document_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and a boolean for each of the filters A to E of every document."""
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    failures = {k: c.alias(k) for k, c in text_failures(F.col("text"), F.col("words")).items()}
    rows = materialize(texts.select("doc_id", "part", *failures.values(), F.sha2("text", 256).alias("text_sha256")), "failures")
    # A text that most rows share costs a row a task here, and its class is broadcast there.
    classes = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    classes = materialize(classes.where("rows > 1"), "classes", compact=True)
    joined = join_classes(rows, classes, "text_sha256", "rows", rows.count())
    return joined.select("doc_id", "part", *failures, F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)).alias("E"))


def all_orders(spark: SparkSession, filters: list[str]) -> DataFrame:
    """One row for each order of the filters: its name, each filter's step, and its steps with the filter's bit."""
    if len(filters) > MOST_FILTERS or any(len(f) != 1 for f in filters):
        raise ValueError(f"orders are listed for up to {MOST_FILTERS} filters, named by a letter each")
    rows = []
    for order in permutations(filters):
        steps = [(k, 1 << filters.index(f)) for k, f in enumerate(order, 1)]
        rows.append(("".join(order), [order.index(f) + 1 for f in filters], steps))
    return spark.createDataFrame(rows, "filter_order string, places array<int>, steps array<struct<step:int,bit:int>>")


def replay(flagged: DataFrame, filters: list[str]) -> DataFrame:
    """Counts by part, order and step over documents with a boolean for each filter, and ``good`` and ``toxic``.

    Result: part, filter_order, step; kept, removed, redundant, unique_fails, good_lost,
    toxic_lost; and shapley, the filter's removals summed over all orders.
    """
    spark = flagged.sparkSession
    mask = sum((F.when(F.col(f), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters)), F.lit(0))
    rows = materialize(flagged.select("part", mask.cast("int").alias("mask"), "good", "toxic"), "flags", compact=True)
    tasks = min(rows.count() // ROWS_A_TASK + 1, MOST_TASKS)
    pairs = rows.repartition(tasks).crossJoin(F.broadcast(all_orders(spark, filters)))
    fails_at = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("places")[i]).otherwise(len(filters) + 1) for i in range(len(filters))]
    first = F.least(*fails_at) if len(fails_at) > 1 else fails_at[0]
    steps = pairs.select("part", "mask", "good", "toxic", "filter_order", first.alias("first"), F.explode("steps").alias("at"))
    step, bit = F.col("at.step"), F.col("at.bit")
    here = F.col("first") == step

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))

    counted = steps.groupBy("part", "filter_order", step.alias("step")).agg(
        count(F.col("first") > step).alias("kept"),
        count(here).alias("removed"),
        count((F.col("mask").bitwiseAND(bit) != 0) & (F.col("first") < step)).alias("redundant"),
        count(F.col("mask") == bit).alias("unique_fails"),
        count(here & F.col("good")).alias("good_lost"),
        count(here & F.col("toxic")).alias("toxic_lost"),
    )
    # From here on there are n * n! rows a part.
    own = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return counted.withColumn("shapley", F.sum("removed").over(own))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over all documents, by language."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flagged = document_failures(docs).join(marks, "doc_id", "left")
    flagged = flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return replay(flagged, list("ABCDE"))
