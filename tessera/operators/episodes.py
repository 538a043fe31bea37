"""Episodes of discovery: a guarded state machine over logs of moves, and trajectories from their records.

A policy has to walk a plan of moves.  A wrong move is refused and changes nothing, so
what a log's later moves come to depends on all before: a distributed scan, not a lag.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.methods import observables
from tessera.functions.scalars import strip
from tessera.operators.scan import states_before

# The plan of an episode, and the vocabulary of moves with their phases.
PLAN = ("survey_consensus", "identify_tension", "formulate_question", "design", "run_experiment", "compare_reference", "interpret_result", "draw_conclusion")
VOCABULARY = {
    "survey_consensus": "FRAME", "identify_tension": "FRAME", "formulate_question": "FRAME", "propose_hypothesis": "FRAME",
    "select_system": "PROBE", "choose_method": "PROBE", "run_calculation": "PROBE", "compare_reference": "PROBE",
    "interpret_result": "RESOLVE", "draw_conclusion": "RESOLVE",
}
RESET = "reset"
ENDED = "episode already terminated; call reset()"


def _planned(state: Column) -> Column:
    """The move that a state expects; null behind the last."""
    return F.try_element_at(F.array(*map(F.lit, PLAN)), state + 1)


def transition(move: Column) -> Column:
    """For each state, how many moves are done behind ``move``: null is the expected one, ``reset`` begins anew."""
    ahead = lambda k: F.when(move == RESET, 0).when(move.isNull() | (move == PLAN[k]), k + 1).otherwise(k)
    return F.array(*[ahead(k) for k in range(len(PLAN))], F.when(move == RESET, 0).otherwise(len(PLAN)))


def judged(steps: DataFrame) -> DataFrame:
    """What the environment answers to each step of known ``state``; ``rewarded`` is the oracle's verdict (null: no)."""
    expected = _planned(F.col("state"))
    reset, ended = F.coalesce(F.col("move") == RESET, F.lit(False)), F.col("state") == len(PLAN)
    taken = F.coalesce("move", expected)
    accepted = reset | (~ended & (taken == expected))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    reason = F.when(~reset & ended, ENDED).when(~accepted, F.concat(F.lit("expected move "), quoted(expected), F.lit(", got "), quoted(taken)))
    done = accepted & ~reset & (F.col("state") == len(PLAN) - 1)
    after = F.when(reset, 0).when(accepted, F.col("state") + 1).otherwise(F.col("state"))
    return steps.select("episode", "idx", "move", F.col("state").cast("int").alias("phase"), expected.alias("expected"), accepted.alias("accepted"), reason.alias("reason"), F.when(done & F.coalesce("rewarded", F.lit(False)), 1.0).otherwise(0.0).alias("reward"), done.alias("done"), _planned(after).alias("next_move"))


def replay_episodes(steps: DataFrame) -> DataFrame:
    """Rows (episode, idx, move, rewarded) to each step's phase, expected move, acceptance, reason of refusal, reward and end.

    Steps of one idx go by move, null first.  A log may go on behind its end: all is
    refused until a reset.  An episode of any length is spread over tasks.
    """
    rows = steps.select("episode", "idx", "move", "rewarded")
    return judged(states_before(rows, ["episode"], ["idx", "move"], transition(F.col("move")), len(PLAN) + 1))


def _remembered(key: tuple, frames: Iterator, state) -> Iterator:
    """One episode's new steps of a micro-batch, from the state that it was left in."""
    import pandas as pd

    (phase,) = state.get if state.exists else (0,)
    steps = pd.concat(list(frames)).sort_values(["idx", "move"], na_position="first", kind="stable")
    before = []
    for move in steps["move"]:
        before.append(phase)
        if move == RESET:
            phase = 0
        elif phase < len(PLAN) and (move is None or pd.isna(move) or move == PLAN[phase]):
            phase += 1
    state.update((phase,))
    yield steps.assign(state=pd.array(before, "int32"))[["episode", "idx", "move", "rewarded", "state"]]


def follow_episodes(steps: DataFrame) -> DataFrame:
    """L8 over a stream: the same answers, with the episode's phase as state; steps of a batch go by idx, batches as they come."""
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema}
    schema = f"episode {kinds['episode']}, idx {kinds['idx']}, move string, rewarded boolean, state int"
    states = steps.select("episode", "idx", "move", "rewarded").groupBy("episode").applyInPandasWithState(_remembered, schema, "phase int", "append", "NoTimeout")
    return judged(states)


# -- trajectories ---------------------------------------------------------------


def base_move(move: Column) -> Column:
    """A move without its label behind a colon; null is empty."""
    return F.substring_index(F.coalesce(move, F.lit("")), ":", 1)


def outside_vocabulary(moves: Column) -> Column:
    """The moves of an array that the vocabulary doesn't have."""
    return F.filter(moves, lambda m: ~F.array_contains(F.array(*map(F.lit, VOCABULARY)), base_move(m)))


def goal_text(premise: Column, tension: Column, motivation: Column) -> Column:
    """What an agent is asked: premise and open question, without the answer."""
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    question = F.when(text(tension) != "", text(tension)).otherwise(text(motivation))
    return strip(F.concat(F.lit("Given the prior understanding that "), text(premise), F.lit(" resolve the following open question: "), question))


def build_trajectories(patterns: DataFrame, records: DataFrame) -> DataFrame:
    """One nested trajectory a pattern from its records (paper_id, idx, move, thought, args, observation).

    ``args`` is a map of strings.  Steps stand in order of idx and are numbered from 0; an
    empty thought is none.  A calculation's observation says what it computes and with
    which tool; the last step, if it concludes, carries the pattern's conclusion.  The
    terminal reward is a rule's where there are handles to compute again, else a model's;
    its value is open.  A pattern without records has no steps.  A trajectory is one row,
    hence its records meet in one task.
    """
    grouped = _grouped_records(records)
    rows = patterns.join(grouped, "paper_id", "left").withColumn("records", F.coalesce("records", F.array().cast(grouped.schema["records"].dataType)))
    rows = rows.withColumn("handles", observables(F.col("key_claims")))
    paper, n = F.col("paper_id"), F.size("records")

    def lay(r: Column, i: Column) -> Column:
        base, terminal = base_move(r["move"]), i == n - 1
        named = lambda k, default: F.coalesce(F.try_element_at(r["args"], F.lit(k)), F.lit(default))
        computed = F.create_map(F.lit("computes"), named("computes", "none"), F.lit("exec_tool"), named("tool", ""))
        found = F.create_map(F.lit("res"), F.when(F.coalesce("conclusion", F.lit("")) != "", F.col("conclusion")).otherwise(r["observation"]))
        content = F.when(terminal & (base == "draw_conclusion"), found).when(base == "run_calculation", computed).otherwise(F.create_map().cast("map<string,string>"))
        reward = F.struct(F.when(F.size("handles") > 0, "rule").otherwise("model").alias("style"), F.lit(True).alias("terminal"), F.col("handles").alias("recompute_handles"), F.when(F.size("handles") == 0, F.col("conclusion")).alias("qualitative_claim"))
        return F.struct(
            i.alias("index"),
            F.when(r["thought"] != "", r["thought"]).alias("thought"),
            F.struct(base.alias("name"), r["args"].alias("params"), paper.alias("raw_ref")).alias("action"),
            F.struct(content.alias("content"), r["observation"].alias("text"), F.lit("finished").alias("process_state"), F.lit(0).alias("exit_status"), paper.alias("raw_ref")).alias("observation"),
            F.when(terminal, reward).alias("reward"),
        )

    moves = F.transform("records", lambda r: r["move"])
    return rows.select(
        F.concat(F.lit("discovery::"), paper.cast("string")).alias("id"),
        "paper_id",
        goal_text(F.col("premise_consensus"), F.col("tension"), F.col("motivation")).alias("goal"),
        F.when(F.size("handles") > 0, F.concat(F.lit("recompute anchors: "), F.array_join("handles", ", "))).alias("task_spec"),
        F.transform("records", lay).alias("steps"),
        F.struct("novelty_move", F.col("handles").alias("recompute_handles"), moves.alias("move_sequence"), outside_vocabulary(moves).alias("escape_hatch_moves"), "title").alias("metadata"),
    )


def _grouped_records(records: DataFrame) -> DataFrame:
    """Records in order of idx, ties by move, thought and observation; maps can't be sorted, so they go as entries."""
    entries = F.coalesce(F.map_entries("args"), F.array().cast("array<struct<key:string,value:string>>"))
    step = F.struct("idx", F.coalesce("move", F.lit("")).alias("move"), "thought", F.coalesce("observation", F.lit("")).alias("observation"), entries.alias("entries"))
    rows = records.groupBy("paper_id").agg(F.array_sort(F.collect_list(step)).alias("kept"))
    back = lambda r: F.struct(r["idx"].alias("idx"), r["move"].alias("move"), r["thought"].alias("thought"), F.map_from_entries(r["entries"]).alias("args"), r["observation"].alias("observation"))
    return rows.select("paper_id", F.transform("kept", back).alias("records"))


def trajectory_records(trajectories: DataFrame) -> DataFrame:
    """The inverse of ``build_trajectories``: a row for each step, with its whole move; empty texts are null there if they were thoughts."""
    rows = trajectories.select("paper_id", "metadata.move_sequence", F.explode("steps").alias("s"))
    return rows.select("paper_id", F.col("s.index").alias("idx"), F.element_at("move_sequence", F.col("s.index") + 1).alias("move"), F.col("s.thought").alias("thought"), F.col("s.action.params").alias("args"), F.col("s.observation.text").alias("observation"))


def wire_verdict(trajectories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The oracle's verdict (paper_id, sane, decisive, valid, notes_valid, notes_invalid) as each trajectory's reward and verification.

    A trajectory without a verdict keeps nulls.  Votes count only where the oracle is real.
    """
    no = F.lit(False)
    v = verdicts.select("paper_id", *(F.coalesce(c, no).alias(c) for c in ("sane", "decisive", "valid")), "notes_valid", "notes_invalid", F.lit(True).alias("__judged"))
    rows = trajectories.join(v, "paper_id", "left")
    value = F.when(F.col("__judged"), F.when(F.col("sane") & F.col("decisive") & F.col("valid"), 1.0).otherwise(0.0))
    votes = F.when(F.col("valid"), F.array("sane", "decisive")).otherwise(F.array().cast("array<boolean>"))
    verification = F.when(F.col("__judged"), F.struct(F.lit(True).alias("reexecuted"), F.col("valid").alias("reproduced"), votes.alias("judge_votes"), F.lit(2).alias("min_judges"), F.when(F.col("valid"), F.col("notes_valid")).otherwise(F.col("notes_invalid")).alias("notes")))
    return rows.withColumns({"reward": value, "verification": verification}).select(*trajectories.columns, "reward", "verification")
