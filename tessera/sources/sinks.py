"""Sinks: tables of any size through Spark's writers, reports of the taxonomy's size as text.

A report's frame has at most a row a code, stage or model, so it may be collected;
nothing else is.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.python_json import python_float, python_json, python_string
from tessera.functions.scalars import file_slug, latex_escape


def one_decimal(value: float) -> str:
    """A rate as reports print it."""
    return f"{value:.1f}"


def to_csv(df: DataFrame, path: str) -> None:
    """K1, K6, K7: a table with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def to_json_lines(df: DataFrame, path: str, *by: str) -> None:
    """One object a line, in folders by columns if given."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def grid_json(labels: DataFrame, records: DataFrame) -> DataFrame:
    """K2: one JSON row a record: [model, task, {code: score}] with nonzero scores alone."""
    scores = labels.where("score > 0").groupBy("model", "task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "score")))).alias("scores"))
    rows = records.select("model", "task").join(scores, ["model", "task"], "left")
    pairs = F.array_join(F.transform(F.map_entries("scores"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"].cast("string"))), ", ")
    inner = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return rows.select("model", "task", F.concat(F.lit("["), inner("model"), F.lit(", "), inner("task"), F.lit(", {"), F.coalesce(pairs, F.lit("")), F.lit("}]")).alias("row"))


def small(df: DataFrame, most: int) -> list:
    """The rows of a report; more than ``most`` are an error, as a report isn't for data."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def markdown(df: DataFrame, most: int = 2000) -> str:
    """A small frame as a table, floats with one decimal."""
    rows = small(df, most)
    cell = lambda v: "" if v is None else one_decimal(v) if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def latex(df: DataFrame, caption: str, most: int = 2000) -> str:
    """K8: a small frame as a tabular with escaped texts."""
    texts = [c for c, t in df.dtypes if t == "string"]
    rows = small(df.withColumns({c: latex_escape(F.col(c)) for c in texts}), most)
    cell = lambda v: "" if v is None else one_decimal(v) if isinstance(v, float) else str(v)
    body = [" & ".join(cell(v) for v in r) + r" \\" for r in rows]
    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", head, r"\hline", *body, r"\end{tabular}", r"\end{table}"]) + "\n"


def status_report(tally: DataFrame) -> tuple[str, int]:
    """A status tally (model, passing, total; a row a model and TOTAL) as text, and the exit code: 0 if all pass."""
    rows = tally.orderBy("model")
    failing = sum(r["total"] - r["passing"] for r in small(rows, 2000))
    return markdown(rows), int(failing > 0)


def sft_lines(messages: DataFrame, admissible: Column) -> DataFrame:
    """A JSON line of messages and loss mask for each admissible trajectory."""
    record = F.struct("messages", "loss_mask")
    kind = messages.select(record.alias("r")).schema["r"].dataType
    return messages.where(F.coalesce(admissible, F.lit(False))).select(python_json(record, kind).alias("value"))


def task_files(tasks: DataFrame, instruction: Column, benchmark: str = "discovery", source: str = "corpus") -> DataFrame:
    """(path, content) of each task's files: ``<task>/task.toml``, ``instruction.md`` and ``tests/task_meta.json``.

    Tasks have task_id, handle, all_handles, novelty_move, tier, tier_weight, qe_ready,
    premise, tension, conclusion, gold (a struct) and paper_gt (an array); nulls are empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    folder, ready = file_slug(F.col("task_id")), F.coalesce("qe_ready", F.lit(False))
    weight = F.coalesce(F.when(F.col("tier_weight") != 0, F.col("tier_weight")), F.lit(1.0))
    fields = [("benchmark", F.lit(benchmark)), ("instance_id", folder), ("category", F.lit("discovery")), ("observable", text("handle")), ("novelty_move", text("novelty_move")), ("tier", text("tier"))]
    head = [F.concat(F.lit(f'{k} = "'), v, F.lit('"\n')) for k, v in fields]
    toml = F.concat(F.lit('version = "1.0"\n\n[metadata]\n'), *head, F.lit("tier_weight = "), python_float(weight), F.lit("\nqe_ready = "), ready.cast("string"), F.lit(f'\nsource = "{source}"\n\n[verifier]\nmodule = "tests.evaluate"\ntimeout_sec = 1800.0\n\n[agent]\ntimeout_sec = 10800.0\n'))
    rubric = F.struct(
        "task_id", text("premise").alias("premise"), text("tension").alias("tension"), text("conclusion").alias("paper_conclusion"), text("novelty_move").alias("novelty_move"), text("handle").alias("observable"),
        F.coalesce("all_handles", F.array().cast("array<string>")).alias("all_observables"), "gold", "paper_gt", text("tier").alias("tier"), weight.alias("tier_weight"), ready.alias("qe_ready"),
    )
    rows = tasks.select(folder.alias("folder"), toml.alias("toml"), instruction.alias("instruction"), F.struct(rubric.alias("rubric")).alias("meta"))
    meta = python_json(F.col("meta"), rows.schema["meta"].dataType, indent=2)
    files = [("task.toml", F.col("toml")), ("instruction.md", F.col("instruction")), ("tests/task_meta.json", meta)]
    each = F.explode(F.array(*[F.struct(F.concat("folder", F.lit(f"/{n}")).alias("path"), c.alias("content")) for n, c in files]))
    return rows.select(each.alias("f")).select("f.*")


def dataset_files(spark: SparkSession, shared: dict[str, str], name: str = "discovery", benchmark: str = "discovery") -> DataFrame:
    """The files of the whole set beside its tasks: ``dataset.toml`` and sources shared by all tests."""
    head = f'version = "1.0"\n[metadata]\nname = "{name}"\nbenchmark = "{benchmark}"\n'
    return spark.createDataFrame([("dataset.toml", head), *((f"tests/{k}", v) for k, v in shared.items())], "path string, content string")


# What each kind of log is called, and its harness.
LOG_FILES = {"claude": "claude_log.jsonl", "gemini": "agent_log.txt", "codex": "agent_log.txt", "codex2": "agent_log.jsonl"}
HARNESSES = {"claude": "claude-code", "gemini": "gemini-cli", "codex": "codex-cli", "codex2": "codex-cli (native JSONL)"}
RAW_MARK = "----- RAW stream-json -----"


def pretty_json(text: Column) -> Column:
    """Any JSON text indented as Python does; null is null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False))

    return run(text)


def workspace_files(trajectories: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """(path, content) of each trajectory's workspace: report, log, decision and meta data.

    Takes the rows of ``sources.files.trajectories``.  ``streams`` (task_id, stream) is put behind
    a log that has no raw part of its own.
    """
    pick = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("log_format"))
    get = lambda p, kind="variant": F.call_function("try_variant_get", F.col("v"), F.lit(p), F.lit(kind))
    rows = trajectories
    log = F.coalesce("log", F.lit(""))
    if streams is not None:
        rows = rows.join(streams.select("task_id", "stream"), "task_id", "left")
        bare = (F.col("log_format") == "gemini") & ~F.contains(log, F.lit(RAW_MARK)) & F.col("stream").isNotNull()
        log = F.when(bare, F.concat(log, F.lit(f"\n{RAW_MARK}\n"), "stream")).otherwise(log)
    rows = rows.withColumns({"log": log, "log_file": pick(LOG_FILES), "decision": F.coalesce(F.to_json(get("$.decision")), F.lit("{}"))})
    meta = F.struct(
        get("$.task_id").alias("task_id"), get("$.reward").alias("reward"), get("$.reason").alias("reason"), get("$.dims").alias("dims"), get("$.wall_clock_s").alias("wall_clock_s"), get("$.resource_monitor").alias("resource_monitor"),
        get("$.decision.observable").alias("observable_text"), "log_format", pick(HARNESSES).alias("agent_cli"), "log_file", F.length("log").alias("log_chars"),
    )
    files = [("report.md", F.coalesce("report_md", F.lit(""))), (None, F.col("log")), ("decision.json", pretty_json(F.col("decision"))), ("meta.json", pretty_json(F.to_json(meta, {"ignoreNullFields": "false"})))]
    named = [F.struct(F.concat(file_slug(F.col("task_id")), F.lit("/"), F.col("log_file") if n is None else F.lit(n)).alias("path"), c.alias("content")) for n, c in files]
    return rows.select(F.explode(F.array(*named)).alias("f")).select("f.*")


def pattern_files(patterns: DataFrame) -> DataFrame:
    """(path, content): each pattern as ``patterns/<paper_id>.json``, with the fields and in the order of its columns."""
    rows = patterns.select("paper_id", F.struct("*").alias("p"))
    return rows.select(F.concat(F.lit("patterns/"), F.col("paper_id").cast("string"), F.lit(".json")).alias("path"), python_json(F.col("p"), rows.schema["p"].dataType, indent=2).alias("content"))


def corpus_map(patterns: DataFrame) -> DataFrame:
    """``corpus_map.json`` of patterns (paper_id, novelty_move, handles, tension): counts by move and by anchor, most first, ties by the first paper.

    Moves and anchors are names; what there is of them is one row each.
    """
    count = lambda rows, c: rows.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("paper_id").alias("first"))
    listed = lambda rows: rows.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "k"))), lambda e: F.concat(python_string(e["k"]), F.lit(": "), (-e["m"]).cast("string"))).alias("l"))
    moves = listed(count(patterns.where("novelty_move is not null"), "novelty_move")).withColumnRenamed("l", "moves")
    anchors = listed(count(patterns.select("paper_id", F.explode("handles").alias("h")), "h")).withColumnRenamed("l", "anchors")
    totals = patterns.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.trim(F.coalesce("tension", F.lit("")))) > 20).alias("tense"), F.count_if(F.size("handles") > 0).alias("anchored"))
    nested = lambda items: F.when(F.size(items) == 0, "{}").otherwise(F.concat(F.lit("{\n    "), F.array_join(items, ",\n    "), F.lit("\n  }")))
    lines = [F.concat(F.lit(f'  "{k}": '), v) for k, v in (("n_papers", F.col("n").cast("string")), ("move_distribution", nested(F.col("moves"))), ("recompute_anchor_distribution", nested(F.col("anchors"))), ("n_with_nontrivial_tension", F.col("tense").cast("string")), ("n_with_recompute_anchor", F.col("anchored").cast("string")))]
    row = totals.crossJoin(moves).crossJoin(anchors)  # one row each
    return row.select(F.lit("corpus_map.json").alias("path"), F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}")).alias("content"))
