"""Resumable runs as keyed state: statuses, attempts, upserts and a pluggable model call.

A pass is: the analyses without a passing result, their statuses from what the
state table knows, one call each, and the new records put over the old ones.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.replies import extract_json


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """U8: new records replace old ones of their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def infra_like(error: Column) -> Column:
    """Errors of transport and provider, which cost no attempt."""
    return F.coalesce(error.rlike("^(transport|truncated)") | error.rlike("http (5|429|408|409)"), F.lit(False))


def plan_status(prior_ok: Column, forced: Column, attempts: Column, most: int) -> Column:
    """L1, L2: skipped or gave_up before any call; null means the call is made."""
    forced = F.coalesce(forced, F.lit(False))
    return F.when(F.coalesce(prior_ok, F.lit(False)) & ~forced, "skipped").when(~forced & (F.coalesce(attempts, F.lit(0)) >= most), "gave_up")


def result_status(answered: Column, error: Column, gate_ok: Column) -> Column:
    """L1: what a call came to."""
    return F.when(~answered, F.when(infra_like(error), "infra_error").otherwise("failed")).when(gate_ok, "done").otherwise("qa_fail")


def charged_attempts(before: Column, status: Column) -> Column:
    """L1: an attempt is charged for content, not for the provider's trouble."""
    return F.coalesce(before, F.lit(0)) + F.when(status.isin("failed", "done", "qa_fail"), 1).otherwise(0)


class Truncated(Exception):
    """An answer that ran into its ceiling of tokens."""


@dataclass(frozen=True)
class Ask:
    """What a client is asked: the prompt, its ceiling of tokens, and which try this is, from 0."""

    prompt: str
    tokens: int
    attempt: int


@dataclass(frozen=True)
class Budget:
    """A ceiling that grows behind a truncated answer, and waits behind trouble of the provider."""

    tokens: int = 16000
    most: int = 64000
    growth: float = 1.8
    retries: int = 3
    wait: float = 2.0
    most_wait: float = 30.0


def answered(prompt: str, complete: Callable[[Ask], str], budget: Budget, sleep: Callable[[float], None]) -> tuple:
    """(reply, error, tries, tokens, waited) of one prompt.

    A truncated answer is asked for again at once, with more room; trouble of the provider (an
    OSError, time-outs too) after a wait that doubles; anything else isn't asked for again.
    """
    tokens, waited = budget.tokens, 0.0
    for attempt in range(budget.retries + 1):
        try:
            return complete(Ask(prompt, tokens, attempt)), None, attempt + 1, tokens, waited
        except Truncated as e:
            error, grown = f"truncated: {e}", min(int(tokens * budget.growth), budget.most)
            if attempt < budget.retries:
                tokens = grown
        except OSError as e:
            error = f"transport: {e}"
            if attempt < budget.retries:
                pause = min(2**attempt * budget.wait, budget.most_wait)
                sleep(pause)
                waited += pause
        except Exception as e:  # noqa: BLE001  one bad row must not end the pass
            return None, f"{type(e).__name__}: {e}", attempt + 1, tokens, waited
    return None, error, budget.retries + 1, tokens, waited


def in_window(items: Iterable, work: Callable, at_once: int) -> Iterator:
    """L3: ``work`` over items in threads: at most ``at_once`` under way or done ahead, results in the items' order."""
    with ThreadPoolExecutor(at_once) as pool:
        under_way: deque = deque()
        for item in items:
            if len(under_way) == at_once:
                yield under_way.popleft().result()
            under_way.append(pool.submit(work, item))
        while under_way:
            yield under_way.popleft().result()


def call_model(prompts: DataFrame, complete: Callable[[Ask], str], at_once: int = 24, budget: Budget = Budget(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """UD3, L3, L5: (key, prompt) to (key, reply, error, tries, tokens, waited).

    Each task keeps up to ``at_once`` calls under way and gives their answers in its rows'
    order; calls over the whole cluster are bounded by the tasks that run times that.  A
    call that fails is an error in its row, not of the job.  A task that runs again asks
    anew.  A null prompt is asked as empty text.
    """

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        rows = ((key, prompt) for batch in batches for key, prompt in zip(batch["key"], batch["prompt"], strict=True))
        work = lambda row: (row[0], *answered(row[1] or "", complete, budget, sleep))
        done = in_window(rows, work, at_once)
        while part := list(islice(done, 256)):
            yield pd.DataFrame(part, columns=["key", "reply", "error", "tries", "tokens", "waited"])

    return prompts.select(F.col("key").cast("string").alias("key"), "prompt").mapInPandas(run, "key string, reply string, error string, tries int, tokens int, waited double")


def answer_table(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """UD3 offline: replies looked up by the prompt's hash; an unknown prompt is an error."""
    known = answers.select(F.sha2("prompt", 256).alias("h"), "reply")
    rows = prompts.withColumn("h", F.sha2("prompt", 256)).join(known, "h", "left")
    return rows.select("key", "reply", F.when(F.col("reply").isNull(), "transport: no stored answer").alias("error"))


def one_pass(tasks: DataFrame, state: DataFrame, call: Callable[[DataFrame], DataFrame], gate: Callable[[Column], Column], most_attempts: int, as_json: bool = False) -> DataFrame:
    """L1 to L4: the state behind one pass over tasks (key, prompt); state has key, status, attempts, reply.

    With ``as_json`` a reply is the JSON found in it, tolerantly (F1); one without any counts as no reply.
    """
    joined = tasks.join(state.select("key", F.col("status").alias("was"), F.col("attempts").alias("before")), "key", "left")
    plan = plan_status(F.col("was").isin("done", "skipped"), F.lit(False), F.col("before"), most_attempts)
    open_ = joined.withColumn("plan", plan).where("plan is null")
    replies = call(open_.select("key", "prompt")).join(open_.select("key", "before"), "key")
    if as_json:
        replies = replies.withColumn("reply", F.to_json(extract_json(F.col("reply"))))
    status = result_status(F.col("reply").isNotNull(), F.col("error"), F.coalesce(gate(F.col("reply")), F.lit(False)))
    new = replies.withColumn("status", status).select("key", "status", charged_attempts(F.col("before"), F.col("status")).alias("attempts"), "reply")
    return upsert(state.select("key", "status", "attempts", "reply"), new, ["key"])


def run_until_complete(tasks: DataFrame, state: DataFrame, call: Callable, gate: Callable, keep: Callable[[DataFrame, int], DataFrame], passes: int = 4, most_attempts: int = 3) -> DataFrame:
    """L4: passes until none is left; ``keep`` writes the state and reads it back, so a later pass can resume."""
    for k in range(passes):
        state = keep(one_pass(tasks, state, call, gate, most_attempts), k)
        if tasks.join(state.where("status = 'done'"), "key", "left_anti").isEmpty():
            break
    return state


def ordered_cascade(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """The first stage that a row fails, by name; admitted if none."""
    fails = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in stages), F.lit("admitted"))
    return rows.withColumn("stage", fails)


def first_admitted(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n admitted rows."""
    return rows.where("stage = 'admitted'").orderBy(*order).limit(n)
