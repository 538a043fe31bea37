"""Label statistics: matrices, root-cause grids, co-occurrence, agreement, kappa.

Inputs are long label rows (model, task, code, score) and one row per analysis;
everything is a grouped aggregate or a join with the 45-row code dimension, which
is broadcast.  Grids are completed from dimensions, never from the labels at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.taxonomy import HIT, PARTIAL

hits = lambda: F.count_if(F.col("score") == HIT)
partials = lambda: F.count_if(F.col("score") == PARTIAL)


def totals_by_code(labels: DataFrame, dim: DataFrame) -> DataFrame:
    """A1: HITs and PARTIALs of every code, zeros included."""
    counts = labels.groupBy("code").agg(hits().alias("hits"), partials().alias("partials"))
    return F.broadcast(dim).join(counts, "code", "left").select("ord", "code", "name", "stage", "pillar", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "partials")))


def grid(labels: DataFrame, dim: DataFrame, key: str, keys: DataFrame, score: int = HIT) -> DataFrame:
    """How many labels of a score each (code, key) has; every cell exists."""
    counts = labels.where(F.col("score") == score).groupBy("code", key).agg(F.count(F.lit(1)).alias("n"))
    cells = keys.select(key).distinct().crossJoin(F.broadcast(dim.select("ord", "code")))
    return cells.join(counts, ["code", key], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def totals_by_model(labels: DataFrame, records: DataFrame, dim: DataFrame) -> DataFrame:
    """A2: HITs and PARTIALs of each (model, code), and each model's analyses, labelled or not."""
    analyses = records.groupBy("model").agg(F.count(F.lit(1)).alias("analyses"))
    counts = labels.groupBy("model", "code").agg(hits().alias("hits"), partials().alias("partials"))
    cells = analyses.crossJoin(F.broadcast(dim.select("code")))
    return cells.join(counts, ["model", "code"], "left").fillna(0, ["hits", "partials"])


def hit_rates(labels: DataFrame, records: DataFrame, dim: DataFrame) -> DataFrame:
    """A4: HITs per hundred analyses, by code."""
    n = records.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("analyses"))
    return totals_by_code(labels, dim).crossJoin(F.broadcast(n)).withColumn("hit_pct", 100.0 * F.col("hits") / F.col("analyses"))


def ranked(totals: DataFrame) -> DataFrame:
    """Codes by HITs descending, then code.  Over the dimension's 45 rows."""
    return totals.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "code")))


def model_load(labels: DataFrame, records: DataFrame) -> DataFrame:
    """A5: each model's HITs, PARTIALs, HITs per analysis and severities ('?' where unknown)."""
    by_record = labels.groupBy("model", "task").agg(hits().alias("hits"), partials().alias("partials"))
    severity = F.coalesce("severity", F.lit("?"))
    rows = records.join(by_record, ["model", "task"], "left").fillna(0, ["hits", "partials"])
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("analyses"), F.sum("hits").alias("hits"), F.sum("partials").alias("partials"), (F.sum("hits") / F.count(F.lit(1))).alias("mean_hits"), *(F.count_if(severity == s).alias(f"severity_{n}") for s, n in (("high", "high"), ("medium", "medium"), ("low", "low"), ("none", "none"), ("?", "unknown"))))


def root_cause_grid(labels: DataFrame, dim: DataFrame, by: list[str] | None = None) -> DataFrame:
    """HITs by stage and pillar with all totals, overall or within columns ``by``."""
    rows = labels.where(F.col("score") == HIT).join(F.broadcast(dim.select("code", "stage", "pillar")), "code")
    if by:
        cells = rows.groupingSets([[*by, "stage", "pillar"], [*by, "stage"], [*by, "pillar"], by], *by, "stage", "pillar")
    else:
        cells = rows.cube("stage", "pillar")
    named = [F.when(F.grouping(c) == 1, "all").otherwise(F.col(c)) for c in ("stage", "pillar")]
    return cells.agg(F.count(F.lit(1)).alias("hits"), named[0].alias("stage_key"), named[1].alias("pillar_key")).select(*(by or []), F.col("stage_key").alias("stage"), F.col("pillar_key").alias("pillar"), "hits")


def slice_rates(labels: DataFrame, records: DataFrame, dim: DataFrame, slice_col: str, first: str, second: str) -> DataFrame:
    """Each code's rate in two slices and their difference in percentage points."""
    n = {s: F.greatest(F.count_if(F.col(slice_col) == s), F.lit(1)) for s in (first, second)}
    sizes = records.agg(n[first].alias("n_first"), n[second].alias("n_second"))
    found = labels.where(F.col("score") == HIT).groupBy("code").agg(*(F.count_if(F.col(slice_col) == s).alias(k) for s, k in ((first, "h_first"), (second, "h_second"))))
    cells = F.broadcast(dim.select("code")).join(found, "code", "left").fillna(0).crossJoin(F.broadcast(sizes))
    rate = {k: 100.0 * F.col(f"h_{k}") / F.col(f"n_{k}") for k in ("first", "second")}
    return cells.select("code", rate["first"].alias("rate_first"), rate["second"].alias("rate_second"), (rate["first"] - rate["second"]).alias("delta_pp"))


def cooccurrence(labels: DataFrame, records: DataFrame, dim: DataFrame) -> DataFrame:
    """Pairs of codes in one analysis, a before b, with supports and lift.

    A task holds at most 45 codes, so pairs grow with analyses alone.
    """
    marked = labels.where(F.col("score") == HIT).join(F.broadcast(dim.select("code", "ord")), "code").select("model", "task", "code", "ord")
    a = marked.select("model", "task", F.col("code").alias("a"), F.col("ord").alias("ord_a"))
    b = marked.select("model", "task", F.col("code").alias("b"), F.col("ord").alias("ord_b"))
    pairs = a.join(b, ["model", "task"]).where("ord_a < ord_b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    support = marked.groupBy("code").agg(F.count(F.lit(1)).alias("s"))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    rows = pairs.join(F.broadcast(support.toDF("a", "n_a")), "a").join(F.broadcast(support.toDF("b", "n_b")), "b").crossJoin(F.broadcast(total))
    lift = (F.col("n") / F.col("total")) / ((F.col("n_a") / F.col("total")) * (F.col("n_b") / F.col("total")))
    return rows.select("a", "b", "n", "n_a", "n_b", F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), F.lit(0.0)).otherwise(lift).alias("lift"))


def top_pairs(pairs: DataFrame, n: int = 40) -> DataFrame:
    """O2: the most frequent pairs, descending in count and both codes."""
    return pairs.orderBy(F.desc("n"), F.desc("a"), F.desc("b")).limit(n)


def agreement(labels: DataFrame, records: DataFrame) -> DataFrame:
    """Per task, codes that all of its models hit, that one hit, and the four most shared."""
    models = records.groupBy("task").agg(F.count_distinct("model").alias("models"))
    by_code = labels.where(F.col("score") == HIT).groupBy("task", "code").agg(F.count_distinct("model").alias("n"))
    joined = by_code.join(models, "task")
    top = F.slice(F.sort_array(F.collect_list(F.struct("n", "code")), asc=False), 1, 4)
    found = joined.groupBy("task").agg(F.count_if(F.col("n") == F.col("models")).alias("universal"), F.count_if(F.col("n") == 1).alias("solo"), top.alias("top"))
    shared = F.array_join(F.transform("top", lambda x: F.concat(x["code"], F.lit(":"), x["n"].cast("string"))), " ")
    return models.join(found, "task", "left").select("task", "models", F.coalesce("universal", F.lit(0)).alias("universal"), F.coalesce("solo", F.lit(0)).alias("solo"), F.coalesce(shared, F.lit("")).alias("shared"))


def kappa(n: Column, both: Column, only_a: Column, only_b: Column) -> Column:
    """Cohen's kappa of two boolean vectors from their counts; null for none."""
    po = (n - only_a - only_b) / n
    pa, pb = (both + only_a) / n, (both + only_b) / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(n == 0, None).when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))


def kappa_by_code(first: DataFrame, second: DataFrame, keys: DataFrame, dim: DataFrame) -> DataFrame:
    """Agreement of two passes on the analyses they share, for codes with a positive on either.

    Negatives are the cells without a label, so they are counted, not formed.
    """
    total = keys.agg(F.count(F.lit(1)).alias("n"))
    marks = [p.where(F.col("score") == HIT).join(keys, ["model", "task"], "left_semi").select("model", "task", "code").distinct().withColumn(k, F.lit(1)) for p, k in ((first, "x"), (second, "y"))]
    both = marks[0].join(marks[1], ["model", "task", "code"], "full").groupBy("code").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("agreed"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"))
    rows = F.broadcast(dim.select("code")).join(both, "code").crossJoin(F.broadcast(total))
    return rows.select("code", "n", "agreed", "only_a", "only_b", kappa(F.col("n"), F.col("agreed"), F.col("only_a"), F.col("only_b")).alias("kappa"))


def rule_frequencies(citations: DataFrame) -> DataFrame:
    """Rows (model, task, rule): analyses that cite each rule, and citations; null rules are ignored."""
    return citations.where("rule is not null").groupBy("rule").agg(F.count_distinct("model", "task").alias("analyses"), F.count(F.lit(1)).alias("citations"))


def status(done: DataFrame) -> DataFrame:
    """Passing and total by model, and over all."""
    return done.rollup("model").agg(F.count_if(F.col("ok")).alias("passing"), F.count(F.lit(1)).alias("total")).select(F.coalesce("model", F.lit("TOTAL")).alias("model"), "passing", "total")


def mechanisms(rows: DataFrame, mechanism: Column, analysis: str) -> DataFrame:
    """K9: findings that no code covers, by mechanism: how many, and in how many analyses; null is (none)."""
    return rows.groupBy(F.coalesce(mechanism, F.lit("(none)")).alias("mechanism")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(analysis).alias("analyses"))


def head_overlap(old: DataFrame, new: DataFrame, n: int = 10, least: int = 4) -> DataFrame:
    """How many of the n most frequent codes two runs share; ties go by taxonomy order.

    Both inputs have one row a code (ord, code, rate).
    """
    tops = [t.orderBy(F.desc("rate"), "ord").limit(n).select("code") for t in (old, new)]
    return tops[0].join(tops[1], "code").agg(F.count(F.lit(1)).alias("overlap")).withColumn("ok", F.col("overlap") >= least)


def tidy_labels(labels: DataFrame, dim: DataFrame) -> DataFrame:
    """A row for each label above zero with its code's attributes; codes that the taxonomy doesn't have drop out.

    ``dim`` has a row a code and is broadcast.
    """
    verdict = F.when(F.col("score") == 2, "HIT").otherwise("PARTIAL")
    rows = labels.where("score > 0").join(F.broadcast(dim.select("code", "name", "stage", "pillar")), "code")
    return rows.select("model", "task", "code", "name", "stage", "pillar", "score", verdict.alias("verdict"))


def polarity(rows: DataFrame, by: str, named: Column, hit: Column, most: float = 0.6) -> DataFrame:
    """How often a subject is named and how often it is a hit, in percent; hits nearly as frequent as mentions are suspect.

    Null counts as no; without any mention or hit nothing is suspect.
    """
    n = F.count(F.lit(1))
    rates = rows.groupBy(by).agg(n.alias("n"), (100.0 * F.count_if(named) / n).alias("mention_pct"), (100.0 * F.count_if(hit) / n).alias("hit_pct"))
    return rates.withColumn("bad", F.col("hit_pct") > most * F.col("mention_pct"))


def remaining(discovered: DataFrame, passing: DataFrame, key: list[str]) -> DataFrame:
    """What has been discovered and has no passing result."""
    return discovered.select(*key).distinct().join(passing.select(*key).distinct(), key, "left_anti")


def taxonomy_counts(dim: DataFrame, labels: DataFrame) -> DataFrame:
    """Codes by stage and by pillar, whether a stage's numbers have no gap, and how many of the codes any label uses."""
    used = dim.join(labels.where("score > 0").select("code").distinct(), "code", "left_semi").select("code", F.lit(1).alias("used"))
    rows = dim.select("code", "stage", "pillar").join(used, "code", "left")
    counts = [F.count(F.lit(1)).alias("n"), F.count("used").alias("used")]
    whole = (F.max(F.split_part("code", F.lit("."), F.lit(2)).cast("int")) == F.count(F.lit(1))).alias("contiguous")
    stages = rows.groupBy(F.lit("stage").alias("kind"), F.col("stage").alias("key")).agg(*counts, whole)
    return stages.unionByName(rows.groupBy(F.lit("pillar").alias("kind"), F.col("pillar").alias("key")).agg(*counts, F.lit(True).alias("contiguous")))
