"""File sources: critiques, trajectories, manifests, papers, registries.

Schemas are declared, never inferred; lines and files that don't parse are dropped
or kept as nulls, as each source says.  Keys come from paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import strip
from tessera.operators.corpus import WORK
from tessera.sources import packs

TRAJECTORY = "task_id string, reward double, reason string, report_md string, claude_log string, gemini_log string, codex_log string"
KNOWN_REASONS = ("judge_unavailable", "no_decision", "no_computation", "timeout")
BLOCKS = "array<struct<type: string, text: string, text_level: int>>"


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, size, body: one row a file, found at any depth; also of files in a pack."""
    if packed := packs.split(path):
        files = packs.read(spark, *packed, glob)
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("body"))


def part(path: Column, from_end: int) -> Column:
    """A component of a path, counted from its end."""
    return F.element_at(F.split(path, "/"), -from_end)


def analyses(spark: SparkSession, corpus: str, manifest: str | None = None) -> DataFrame:
    """corpus/model/task/analysis.md by path; directories that begin with an underscore aren't models."""
    rows = whole_files(spark, corpus, "analysis.md").select("path", part(F.col("path"), 3).alias("model"), part(F.col("path"), 2).alias("task"), "body")
    rows = rows.where(~F.startswith("model", F.lit("_")))
    sets = source_sets(spark, manifest) if manifest else spark.createDataFrame([], "task string, source_set string")
    return rows.join(sets, "task", "left").select("model", "task", F.coalesce("source_set", F.lit("unknown")).alias("source_set"), "path", "body")


def source_sets(spark: SparkSession, path: str) -> DataFrame:
    """Task and set of a TSV with a header; short rows go, the last of equal tasks wins."""
    lines = whole_lines(spark, path)
    cells = F.split("text", "\t")
    rows = lines.where((F.col("line") > 0) & (F.size(cells) >= 2)).select(cells[0].alias("task"), cells[1].alias("source_set"), "line")
    return rows.groupBy("task").agg(F.max_by("source_set", "line").alias("source_set"))


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """Path, line, text; lines end at line feeds alone.

    Large files are read in blocks.  A line's number is its place in its block after the
    lines of the file's earlier blocks, of which there is one row each.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.make_valid_utf8("value").alias("text"))
    blocks = rows.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("path", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    # One narrow row a block of a file: where they are few, Spark broadcasts them by their measured size.
    return rows.join(bases, ["path", "_block"]).select("path", (F.col("_id") + F.col("_base")).alias("line"), "text")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects by line; blank and broken lines are skipped."""
    rows = whole_lines(spark, path).where(F.expr("try_parse_json(text)").isNotNull())
    return rows.select("path", "line", F.from_json("text", schema).alias("o")).where("o is not null").select("path", "line", "o.*")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """One topic a line, without comments and blank lines, in order."""
    rows = whole_lines(spark, path).withColumn("topic", strip("text"))
    return rows.where((F.col("topic") != "") & ~F.startswith("topic", F.lit("#"))).select("path", "line", "topic")


def trajectories(spark: SparkSession, run_dir: str) -> DataFrame:
    """run/traj/*.json; files that don't parse are skipped."""
    raw = whole_files(spark, f"{run_dir}/traj", "*.json").where(F.expr("try_parse_json(body)").isNotNull())
    d = raw.select("path", F.expr("try_parse_json(body)").alias("v"), F.from_json("body", TRAJECTORY).alias("o")).select("path", "v", "o.*")
    logs = [("claude", "claude_log"), ("gemini", "gemini_log"), ("codex", "codex_log")]
    filled = [F.when(F.coalesce(F.col(c), F.lit("")) != "", k) for k, c in logs]
    present = [F.when(F.expr(f"variant_get(v, '$.{c}', 'variant')").isNotNull(), k) for k, c in logs]
    kind = F.coalesce(*filled, *present, F.lit("claude"))
    log = F.coalesce(*(F.when(kind == k, F.coalesce(F.col(c), F.lit(""))) for k, c in logs))
    reason = F.coalesce("reason", F.lit(""))
    category = F.coalesce(*(F.when(F.startswith(reason, F.lit(p)), p) for p in KNOWN_REASONS), F.lit("soft"))
    return d.select("path", "task_id", "reward", reason.alias("reason"), category.alias("category"), kind.alias("log_format"), F.length(log).alias("log_chars"), log.alias("log"), "report_md", "v")


def classifications(spark: SparkSession, root: str) -> DataFrame:
    """root/model/task.json with the raw body; the gate decides what is wrong with it."""
    return whole_files(spark, root, "*.json").select(part(F.col("path"), 2).alias("model"), F.regexp_replace(part(F.col("path"), 1), r"\.json$", "").alias("task"), "path", "body")


def paper_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of parsed papers below ``<id>.mineru/``; of two copies the vlm one; in order of id."""
    files = whole_files(spark, root, "*content_list.json").withColumn("paper_id", F.regexp_extract("path", r"([^/]+)\.mineru/", 1)).where("paper_id != ''")
    best = files.groupBy("paper_id").agg(F.max_by(F.struct("path", "body"), F.struct(F.contains("path", F.lit("/vlm/")), F.col("path"))).alias("f"))
    return best.select("paper_id", F.col("f.path").alias("path"), F.posexplode(F.from_json("f.body", BLOCKS)).alias("pos", "b")).select("paper_id", "path", "pos", "b.*")


def pattern_sets(spark: SparkSession, folders: dict[str, str], schema: str) -> DataFrame:
    """Folders of pattern files under their labels, projected to known fields; missing folders are skipped."""
    parts = []
    for label, folder in folders.items():
        if exists(spark, folder):
            rows = whole_files(spark, folder, "*.json").select(F.lit(label).alias("set"), "path", F.from_json("body", schema).alias("o"))
            parts.append(rows.where("o is not null").select("set", "path", "o.*"))
    if not parts:
        return spark.createDataFrame([], f"set string, path string, {schema}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store it names; a path in a pack does if the pack does."""
    at = spark._jvm.org.apache.hadoop.fs.Path((packs.split(path) or (path,))[0])
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def registry(spark: SparkSession, path: str, field: str, entry: str) -> DataFrame:
    """The entries of a registry file by id."""
    return whole_files(spark, path).select(F.explode(F.from_json("body", f"{field} array<struct<{entry}>>")[field]).alias("e")).select("e.*")


def prior_scores(spark: SparkSession, path: str) -> DataFrame:
    """Model, task, code, score of an aggregate file {rows: [[model, task, {code: score}]]}."""
    rows = whole_files(spark, path).select(F.explode(F.expr("try_variant_get(try_parse_json(body), '$.rows', 'array<variant>')")).alias("r"))
    get = lambda p, t: F.call_function("try_variant_get", F.col("r"), F.lit(p), F.lit(t))
    return rows.select(get("$[0]", "string").alias("model"), get("$[1]", "string").alias("task"), F.explode(get("$[2]", "map<string,int>")).alias("code", "score"))


# Files that an analysis may quote, in order; the first two are the artifact.
QUOTED = ("report.md", "decision.json", "agent_log.jsonl", "agent_log.txt", "gemini_stream.jsonl", "gold_rubric.json", "task_instruction.md", "task_index.json", "traj_tools.py", "INSTRUCTION.md", "result.json", "submissions.jsonl", "problem_readme.md", "data_description.md", "verification.md", "task_metadata.json")
QUOTED_FOLDERS = ("agent_code", "evaluator", "ground_truth")


def quotable(spark: SparkSession, workspaces: str) -> DataFrame:
    """Per workspace all text that may be quoted, and the artifact's; files in folders below 2 MB each."""
    files = whole_files(spark, workspaces)
    below = F.regexp_extract("path", f"{workspaces.removeprefix('file://').rstrip('/')}/([^/]+)/(.*)$", 2)
    d = files.withColumns({"workspace": F.regexp_extract("path", f"{workspaces.removeprefix('file://').rstrip('/')}/([^/]+)/", 1), "below": below})
    named = F.array_position(F.array(*map(F.lit, QUOTED)), F.col("below"))
    inside = F.col("below").rlike("^(" + "|".join(QUOTED_FOLDERS) + ")/") & (F.col("size") < 2_000_000)
    kept = d.withColumn("place", F.when(named > 0, named).when(inside, 100)).where("place is not null")
    text = lambda only: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(only, F.struct("place", "below", "body")))), lambda x: x["body"]), "\n")
    return kept.groupBy("workspace").agg(text(F.lit(True)).alias("quotable"), F.nullif(text(F.col("place") <= 2), F.lit("")).alias("artifact"))


def works(spark: SparkSession, path: str) -> DataFrame:
    """Stored metadata answers, one work a line, in the declared shape."""
    return json_lines(spark, path, WORK)
