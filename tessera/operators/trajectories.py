"""Trajectories: derived fields, admission lints, restart lifting and training export.

Steps are rows (trajectory_id, index, ...).  Whole-trajectory facts come from one
grouped aggregate or a window over the trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from tessera.functions.python_json import python_json
from tessera.functions.scalars import any_of, non_null
from tessera.operators.episodes import VOCABULARY

# Words by which lints know claims, and parameters' names.
VERDICT = r"(?i)\b(we (conclude|demonstrate|show that)|in conclusion|this (confirms|proves|establishes))\b"
SUCCESS = ("converged", "success", "finished successfully", "settled")
MECHANISMS = ("oscillat", "charge density", "charge-density", "charge sloshing", "sloshing", "failed to settle", "did not settle", "instabilit", "diverg", "too large")
CLAIMED = ("now converged", "has converged", "have converged", "successfully converged", "converged successfully", "scf converged", "it converged", "run converged", "finally converged", "reached convergence", "is converged", "did converge")
RESTART_CLAIMS = ("restarting from", "restart from the", "continuing the previous", "continuing from the previous", "recovering from the", "from the previous run", "resuming the", "picking up from", "continue the previous")
RESTART_KEYS = ("restart_mode", "startingpot")
DROPPED_KEYS = ("max_seconds",)


def step_succeeded(exit_status: Column, state: Column) -> Column:
    """A step without an error code and in no state but finished; all unknown counts as success."""
    return ~(F.coalesce(exit_status != 0, F.lit(False))) & ~(F.coalesce(state != "finished", F.lit(False)))


def failure_branch(exit_status: Column, state: Column, exception: Column, correction: Column) -> Column:
    """Any sign of failure or of a correction."""
    return F.coalesce(exit_status != 0, F.lit(False)) | F.coalesce(state.isin("excepted", "killed"), F.lit(False)) | exception.isNotNull() | correction.isNotNull()


def admissible(reexecuted: Column, reproduced: Column, votes: Column, least: Column) -> Column:
    """Run again, reproduced, and enough judges for it."""
    return F.coalesce(reexecuted & reproduced & (F.size(F.filter(votes, lambda v: v)) >= least), F.lit(False))


def error_recovery(exits: Column) -> Column:
    """The last exit is 0 and an earlier one is neither 0 nor null."""
    earlier = F.slice(exits, F.lit(1), F.greatest(F.size(exits) - 1, F.lit(0)))
    return F.coalesce((F.try_element_at(exits, F.lit(-1)) == 0) & F.exists(earlier, lambda e: F.coalesce(e != 0, F.lit(False))), F.lit(False))


def summaries(steps: DataFrame) -> DataFrame:
    """Per trajectory: steps, success of the last, any failure branch, exits in order, recovery."""
    ok = step_succeeded(F.col("exit_status"), F.col("state"))
    marked = steps.withColumns({"ok": ok, "failed": failure_branch(F.col("exit_status"), F.col("state"), F.col("exception"), F.col("correction"))})
    by = marked.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("steps"), F.max_by("ok", "index").alias("succeeded"), F.bool_or("failed").alias("any_failure"), F.transform(F.array_sort(F.collect_list(F.struct("index", "exit_status"))), lambda x: x["exit_status"]).alias("exits"))
    return by.withColumn("recovery", error_recovery(F.col("exits")))


def arc_problems(steps: DataFrame) -> DataFrame:
    """Rows (traj_id, idx, move, thought, observation) to each trajectory's ordered problems."""
    order = Window.partitionBy("traj_id").orderBy("idx")
    whole = Window.partitionBy("traj_id")
    base = F.substring_index("move", ":", 1)
    phase = F.try_element_at(F.create_map(*[F.lit(x) for kv in VOCABULARY.items() for x in kv]), base)
    s = steps.withColumns({"base": base, "phase": phase, "n": F.count(F.lit(1)).over(whole), "place": F.row_number().over(order) - 1})
    s = s.withColumn("left_frame", F.coalesce(F.max(F.col("phase").isin("PROBE", "RESOLVE")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    s = s.withColumn("first_calc", F.coalesce(F.min(F.when(F.col("base") == "run_calculation", F.col("place"))).over(whole), F.col("n")))
    said = F.concat_ws(" ", F.coalesce("thought", F.lit("")), F.coalesce("observation", F.lit("")))
    quoted = F.concat(F.lit("'"), "move", F.lit("'"))
    at = lambda k, c: F.struct(F.lit(k).alias("k"), F.col("place").alias("place"), c.alias("text"))
    found = non_null(
        F.when((F.col("place") == 0) & ~F.startswith("move", F.lit("survey_consensus")), at(0, F.concat(F.lit("first move is "), quoted, F.lit(", expected survey_consensus")))),
        F.when((F.col("place") == F.col("n") - 1) & ~F.startswith("move", F.lit("draw_conclusion")), at(1, F.concat(F.lit("last move is "), quoted, F.lit(", expected draw_conclusion")))),
        F.when((F.col("phase") == "FRAME") & F.col("left_frame"), at(2, F.concat(F.lit("framing move "), quoted, F.lit(" after experimentation started")))),
        F.when((F.col("place") < F.least("first_calc", F.col("n") - 1)) & said.rlike(VERDICT), at(3, F.concat(F.lit("verdict leakage before any computation, step "), F.col("place").cast("string"), F.lit(" ("), quoted, F.lit(")")))),
    )
    rows = s.withColumn("found", found).groupBy("traj_id").agg(F.transform(F.array_sort(F.flatten(F.collect_list("found"))), lambda x: x["text"]).alias("problems"))
    return rows.withColumn("ok", F.size("problems") == 0)


def thought_lint(steps: DataFrame) -> DataFrame:
    """T4: recovery chains whose thoughts claim no success on a failed step, no restart first, no unseen mechanism.

    A mechanism is seen if any step's text names it: one flag a mechanism and step, so no
    step carries the text of its trajectory.  Words that only come together where two texts
    meet don't name it.
    """
    th, text = F.lower(F.coalesce("thought", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    bad_exit = F.coalesce(F.col("exit_status") != 0, F.lit(False))
    claims = {f"said{k}": F.contains(th, F.lit(m)) for k, m in enumerate(MECHANISMS)} | {f"seen{k}": F.contains(text, F.lit(m)) for k, m in enumerate(MECHANISMS)}
    clean = (th != "") & ~(bad_exit & any_of(th, SUCCESS))
    s = steps.select("trajectory_id", "index", "exit_status", clean.alias("clean"), any_of(th, ("restart", "recover", "previous run")).alias("restarts"), *(c.alias(n) for n, c in claims.items()))
    exits = F.transform(F.array_sort(F.collect_list(F.struct("index", "exit_status"))), lambda x: x["exit_status"]).alias("exits")
    rows = s.groupBy("trajectory_id").agg(F.bool_and("clean").alias("clean"), F.min_by("restarts", "index").alias("restarts"), *(F.bool_or(n).alias(n) for n in claims), exits)
    unseen = F.lit(False)
    for k in range(len(MECHANISMS)):
        unseen = unseen | (F.col(f"said{k}") & ~F.col(f"seen{k}"))
    return rows.select("trajectory_id", (F.col("clean") & ~F.col("restarts") & ~unseen & error_recovery(F.col("exits"))).alias("ok"))


def scientist_lint(steps: DataFrame) -> DataFrame:
    """T5: the first failing reason in step order, else ok."""
    whole = Window.partitionBy("trajectory_id")
    th, tag = F.lower(F.coalesce("thought", F.lit(""))), F.concat(F.lit("step"), F.col("index").cast("string"))
    reason = F.coalesce(
        F.when(th == "", F.concat(tag, F.lit(": empty thought"))),
        F.when(F.coalesce(F.col("exit_status") != 0, F.lit(False)) & any_of(th, CLAIMED), F.concat(tag, F.lit(": claims convergence on a FAILED step"))),
        F.when((F.min("index").over(whole) == F.col("index")) & any_of(th, RESTART_CLAIMS), F.lit("step0: treats the first action as a restart")),
    )
    rows = steps.withColumn("reason", reason).groupBy("trajectory_id").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("index"))).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("index", "exit_status"))), lambda x: x["exit_status"]).alias("exits"))
    text = F.when(~error_recovery(F.col("exits")), "not a real error→recovery chain").otherwise(F.coalesce("first", F.lit("ok")))
    return rows.select("trajectory_id", text.alias("reason"), (text == "ok").alias("ok"))


# -- restarts ---------------------------------------------------------------


def flatten_params(params: Column) -> Column:
    """a map of sections to a map of SECTION.key."""
    return F.map_from_entries(F.flatten(F.transform(F.map_entries(params), lambda s: F.transform(F.map_entries(s["value"]), lambda e: F.struct(F.concat(s["key"], F.lit("."), e["key"]).alias("key"), e["value"].alias("value"))))))


def leaf_params(params: Column) -> Column:
    """the leaves alone; a later section's leaf replaces an earlier one's."""
    entries = F.flatten(F.transform(F.map_entries(params), lambda s: F.map_entries(s["value"])))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"].alias("value"))))


def changed_params(before: Column, now: Column) -> Column:
    """keys of ``now`` that are new or differ, by their leaf names; the last of equal leaves wins."""
    entries = F.transform(F.filter(F.map_entries(now), lambda e: ~e["value"].eqNullSafe(F.try_element_at(before, e["key"]))), lambda e: F.struct(F.element_at(F.split(e["key"], r"\."), -1).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"].alias("value"))))


def restart_move(before: Column, now: Column) -> Column:
    """The named recovery that a restart's changes amount to, and its parameters, sorted by key."""
    keys = F.filter(F.array_sort(F.array_union(F.map_keys(before), F.map_keys(now))), lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(now, k)) & ~k.isin(*DROPPED_KEYS))
    number = lambda m, k: F.try_element_at(m, F.lit(k)).try_cast("double")
    has = lambda k: F.array_contains(keys, F.lit(k))
    pick = lambda ks: F.transform(ks, lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(now, k), F.lit("None"))))
    move = (
        F.when(F.size(keys) == 0, "restart_from_charge_density")
        .when(has("mixing_beta") & (number(now, "mixing_beta") < number(before, "mixing_beta")), "damp_charge_mixing")
        .when(has("nbnd") & (number(now, "nbnd") > F.coalesce(number(before, "nbnd"), F.lit(0.0))), "add_empty_bands")
        .when(has("starting_magnetization"), "reseed_magnetization")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, RESTART_KEYS)))) == 0, "restart_from_charge_density")
        .when(F.size(keys) >= 5, "resubmit_from_scratch")
        .otherwise("adjust_scf_parameters")
    )
    one = {"damp_charge_mixing": "mixing_beta", "add_empty_bands": "nbnd", "reseed_magnetization": "starting_magnetization"}
    params = F.coalesce(*(F.when(move == m, pick(F.array(F.lit(k)))) for m, k in one.items()), F.when(move == "restart_from_charge_density", F.array().cast("array<string>")), F.when(move == "resubmit_from_scratch", pick(F.slice(keys, 1, 6))), pick(keys))
    return F.struct(move.alias("move"), params.alias("params"))


def lift_restarts(steps: DataFrame) -> DataFrame:
    """Rows (chain_id, idx, params) of leaf parameters, to a named move a step; the first is the run itself."""
    before = F.lag("params").over(Window.partitionBy("chain_id").orderBy("idx"))
    lifted = steps.withColumn("before", before).withColumn("lift", restart_move(F.col("before"), F.col("params")))
    first = F.col("before").isNull()
    return lifted.select("chain_id", "idx", F.when(first, "run_scf").otherwise(F.col("lift.move")).alias("move"), F.when(first, F.array().cast("array<string>")).otherwise(F.col("lift.params")).alias("params"))


def diagnosed_text(exit_status: Column, energy: Column, iterations: Column) -> Column:
    """what an archived run's facts allow to be said."""
    ran = F.when(F.coalesce(iterations, F.lit(0)) != 0, iterations.cast("string"))
    good = F.concat(F.lit("Observation: SCF converged"), F.coalesce(F.concat(F.lit(" in "), ran, F.lit(" iterations")), F.lit("")), F.coalesce(F.concat(F.lit("; total energy = "), F.format_string("%.4f", energy), F.lit(" eV")), F.lit("")), F.lit("."))
    bad = F.concat(F.lit("Observation: SCF did NOT converge (exit_status="), F.coalesce(exit_status.cast("string"), F.lit("None")), F.lit("); the run terminated"), F.coalesce(F.concat(F.lit(" after "), ran, F.lit(" iterations")), F.lit("")), F.lit(" without producing a converged ground-state energy."))
    return F.when(exit_status == 0, good).otherwise(bad)


# -- training export ---------------------------------------------------------


def spaced_json(params: Column) -> Column:
    """A map of strings as JSON with sorted keys, a space behind each colon and comma."""
    return python_json(params, MapType(StringType(), StringType()), sort_keys=True)


def chat_messages(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """Messages (role, content) with an aligned loss mask; the assistant's turns alone are learned.

    Steps have params as a map and text; a trajectory without steps still has its
    system, user and final messages.
    """
    act = F.concat(F.when(F.coalesce("thought", F.lit("")) != "", F.concat(F.lit("Thought: "), "thought", F.lit("\n"))).otherwise(""), F.lit("Action: "), "name", F.lit("("), spaced_json(F.col("params")), F.lit(")"))
    failed = F.coalesce(F.col("exit_status") != 0, F.lit(False))
    prefix = F.when(failed, F.rtrim(F.concat(F.lit("Observation: [error exit_status="), F.col("exit_status").cast("string"), F.lit(" "), F.coalesce("exit_message", F.lit("")), F.lit("]")))).otherwise("Observation:")
    saw = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.trim(prefix))
    pair = F.array(F.struct(F.lit("assistant").alias("role"), act.alias("content")), F.struct(F.lit("tool").alias("role"), saw.alias("content")))
    turns = steps.withColumn("pair", pair).withColumn("good", step_succeeded(F.col("exit_status"), F.col("state"))).groupBy("trajectory_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("index", "pair")))["pair"]).alias("turns"), F.max_by("good", "index").alias("good"), F.max_by("exit_message", "index").alias("last_message"))
    d = trajectories.join(turns, "trajectory_id", "left")
    answer = F.when(F.col("turns").isNull(), "done").when(F.col("good"), "Completed successfully.").otherwise(F.concat(F.lit("Run did not converge cleanly: "), F.coalesce("last_message", F.lit("see observations")), F.lit(".")))
    say = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    none = F.array().cast("array<struct<role string, content string>>")
    messages = F.concat(say("system", F.col("system_prompt")), say("user", F.col("goal")), F.coalesce("turns", none), say("assistant", F.concat(F.lit("Final Answer: "), answer)))
    return d.select("trajectory_id", messages.alias("messages")).withColumn("loss_mask", F.transform("messages", lambda m: F.when(m["role"] == "assistant", 1).otherwise(0)))
