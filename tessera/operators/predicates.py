"""Small predicates and projections over patterns, tasks and episodes: column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import strip
from tessera.operators.scoring import CROSS_METHOD

# Restart keys of the phonon code; parameters that specs know; a task's meta fields with their defaults.
PHONON_KEYS = ("alpha_mix(1)", "fildrho", "fildvscf", "epsil", "tr2_ph", "niter_ph", "recover", "fildyn")
META = ("tension", "premise", "conclusion", "novelty_move")


def phonon_chain(steps: Column) -> Column:
    """Whether a step's flattened parameters (an array of maps) hold a key of the phonon code.

    Keys of a section are ``SECTION.key`` there, so only top-level ones match.
    """
    return F.exists(steps, lambda p: F.arrays_overlap(F.map_keys(p), F.array(*map(F.lit, PHONON_KEYS))))


def cross_method(claim: Column, raw: Column) -> Column:
    """A claim that rests on another method or on experiment."""
    return F.concat(F.coalesce(claim, F.lit("")), F.lit(" "), F.coalesce(raw, F.lit(""))).rlike(CROSS_METHOD)


def real_tension(tension: Column) -> Column:
    """A tension of over 20 characters."""
    return F.length(strip(F.coalesce(tension, F.lit("")))) > 20


def task_meta(tasks: DataFrame) -> DataFrame:
    """What the verifier reads of a task; tier A where there is gold, else B."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    gold = F.coalesce("gold", F.lit(""))
    handle = F.coalesce("handle", F.lit("site_preference")).alias("recompute_handle")
    tier = F.when(F.coalesce("tier", F.lit("")) != "", F.col("tier")).when(gold != "", "A").otherwise("B").alias("tier")
    return tasks.select("task_id", *map(text, META), handle, gold.alias("gold"), tier, F.coalesce("unverified", F.lit(False)).alias("unverified"))


def known_fields(fields: Column, annotations: Column) -> Column:
    """Of a map the entries whose key a spec has."""
    return F.map_filter(fields, lambda k, v: F.array_contains(annotations, k))


def rewarded(sane: Column, decisive: Column, valid: Column) -> Column:
    """An episode counts if its oracle is real and settled it sanely; unknown counts as no."""
    no = F.lit(False)
    return F.coalesce(sane, no) & F.coalesce(decisive, no) & F.coalesce(valid, no)


def gated_reconstruct(rows: DataFrame, kept: Column, method: str, model: str) -> DataFrame:
    """The rows that a gate keeps, stamped with their method and teacher; the others go unstamped."""
    return rows.where(F.coalesce(kept, F.lit(False))).withColumns({"reconstruct_method": F.lit(method), "teacher_model": F.lit(model)})


def faithful(steps: DataFrame, archive: DataFrame) -> DataFrame:
    """P25: per trajectory whether each step (trajectory_id, node, exit) ended as its archived node (node, archived) did; an unknown node didn't."""
    same = F.coalesce(F.col("archived") == F.col("exit"), F.lit(False))
    return steps.join(archive, "node", "left").groupBy("trajectory_id").agg(F.bool_and(same).alias("faithful"))


def chain_links(attempts: DataFrame) -> DataFrame:
    """Of attempts (chain, place, input) each with the next one, and whether both have the same input."""
    child = attempts.select("chain", (F.col("place") - 1).alias("place"), F.col("place").alias("child"), F.col("input").alias("next"))
    return attempts.join(child, ["chain", "place"]).select("chain", F.col("place").alias("parent"), "child", (F.col("input") == F.col("next")).alias("same_input"))


def norm(vector: Column) -> Column:
    """A vector's length, summed in doubles."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def prefilter(force: Column, energy: Column, reference: Column, most_force: float, most_off: float) -> Column:
    """Forces within tolerance, and an energy near its reference where there is one."""
    return (force <= most_force) & (reference.isNull() | (F.abs(energy - reference) <= most_off))


def distribution(rows: DataFrame, value: Column, paper: str) -> DataFrame:
    """Values with their counts and distinct papers; null is (none)."""
    counted = rows.groupBy(F.coalesce(value, F.lit("(none)")).alias("move"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(paper).alias("papers"))


def allowed(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return rows.join(ids.select(key), key, "left_semi")


def looked_up(rows: DataFrame, execution: DataFrame, discovery: DataFrame, key: str) -> DataFrame:
    """The name of an id by the execution registry, else by that of discovery; both are (key, name)."""
    first, second = execution.withColumnRenamed("name", "_first"), discovery.withColumnRenamed("name", "_second")
    found = rows.join(first, key, "left").join(second, key, "left")
    return found.withColumns({"name": F.coalesce("_first", "_second"), "execution": F.col("_first").isNotNull()}).drop("_first", "_second")
