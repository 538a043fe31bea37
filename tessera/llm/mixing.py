"""Operator 10: mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash.  A document's copy gets a virtual
finish time: the source's tokens up to and with it, divided by the source's target.
All copies are then range-sorted by that time over all sources and cut at the budget.
Ties go by source, shuffle hash and doc_id.  Null text has size 0; a null source is a
source of its own, the last.  Texts of any length count whole.  Repeated rows are
separate documents; an empty table gives an empty result.  The hash depends on doc_id
alone, so reruns agree.  Targets are computed by windows over one row a source in one
task: sources are named by people, not by data; all else is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, ordered_sums

#: Weights of the sources in code point order, repeating; times that a source may be used.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3


def word_count(text: str = "text"):
    """Runs of characters other than space and 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """Per source (columns source, source_size): its rank and target; sums are exact integers.

    Sources whose cap ``most * source_size`` lies below their share stop there, and
    the others share what is left by weight.  In order of cap / weight the capped
    ones come first, so one pass over running sums finds where capping ends.
    """
    everywhere = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(everywhere))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = capped.withColumns({"left": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "shared": F.sum("weight").over(after)})
    # A source is the first that isn't capped if the level with all before it capped lies within its own cap.
    fits = level.withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("shared"))
    first = F.min_by(F.struct("left", "shared", "cap", "weight"), F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(everywhere)
    chosen = fits.withColumn("first", first)
    share = F.col("weight") * F.col("first.left") / F.col("first.shared")
    return chosen.select("source", "source_size", "rank", F.least(F.col("cap").cast("double"), share).alias("target"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken, and copies begun."""
    sized = materialize(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets", compact=True)
    renamed = targets.withColumnRenamed("source", "_source")
    rows = sized.join(renamed, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_shuffle", F.md5(F.concat(F.lit("mix/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    queued = ordered_sums(rows, "size", "rank", ["_shuffle", "doc_id", "size"], "queues").withColumn("_row", F.monotonically_increasing_id())
    queued = materialize(queued, "queued")
    # A source queues until its target is reached, and its last document only as far: so each comes within a word of its target.
    copies = queued.where("size > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.withColumn("_begin", F.col("_copy") * F.col("source_size") + F.col("_start")).where(F.col("_begin") < F.col("target"))
    copies = copies.withColumn("_take", F.least(F.col("size"), F.ceil("target") - F.col("_begin")))
    finish = (F.col("_begin") + F.col("_take")) / F.col("target")
    copies = copies.select("_row", "_take", "rank", "_shuffle", "doc_id", "_copy", finish.alias("_finish"))
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_budget"))
    line = ordered_sums(copies, "_take", None, ["_finish", "rank", "_shuffle", "doc_id", "_copy"], "line")
    cut = line.crossJoin(F.broadcast(budget)).where(F.col("_start") < F.col("_budget"))
    taken = cut.groupBy("_row").agg(F.sum(F.least("_take", F.col("_budget") - F.col("_start"))).alias("taken"), F.count(F.lit(1)).cast("int").alias("copies"))
    out = queued.join(taken, "_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source", F.coalesce("copies", F.lit(0)).alias("copies"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n), "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: whole copies, then the words that it takes of a last one.

    Only where a source or the budget ends is a text cut, so the rows hold as many words as
    ``take_mix`` says.  Other columns are unchanged, also ones that tell of the whole text.
    Rows with the same doc_id, source and number of words are each taken as the most used of them.
    """
    used = take_mix(docs, weights, most).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.max("taken").alias("__taken"))
    used = materialize(used.withColumnsRenamed({"doc_id": "__id", "source": "__from", "size": "__size"}), "used", compact=True)
    # Hashed on the narrow side, so that whole texts are shuffled once and never sorted.  The row is one column, whatever its own are called.
    keyed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__key"), F.col("source").alias("__origin"), word_count().alias("__words"))
    rows = keyed.join(used.hint("shuffle_hash"), F.col("__key").eqNullSafe(F.col("__id")) & F.col("__origin").eqNullSafe(F.col("__from")) & (F.col("__words") == F.col("__size")))
    times = F.sequence(F.lit(0), F.expr("cast((__taken - 1) div __size as int)"))
    rows = rows.select("__row", "__size", "__taken", F.explode(times).alias("__copy"))
    left = F.least("__size", F.col("__taken") - F.col("__copy") * F.col("__size")).cast("int")
    text = F.when(left < F.col("__size"), first_words(F.col("__row.text"), left)).otherwise(F.col("__row.text"))
    return rows.select(F.col("__row").withField("text", text).alias("__row")).select("__row.*")
