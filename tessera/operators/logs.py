"""Agent logs in four dialects as canonical tool events, and files replayed from them.

A log is one row (log_id, body).  Each dialect becomes an ordered event table with
the columns seq, kind (tool or text), name, params (JSON text), result, uid.  The
plain-text dialect is cut by look-ahead; the three JSON dialects go through VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.scalars import first_group, first_url, looks_like_path, one_line
from tessera.sources.scratch import folder

# The grammars of the dialects.
RAW_MARK = r"(?md)^----- RAW stream-json -----$"
PROSE_CALL = r"(?md)^(?:\S+ )?Tool call: (\S+) (\{.*)$"
PROSE_RESULT = r"(?md)^Tool result \(([^)]*)\): ?"
BLOCK_SPLIT = r"(?md)(?=^(?:exec\n(?:/bin/)?bash -lc? |apply patch\npatch: ))"
BLOCK_RESULT = r"(?md)^ (succeeded|exited \d+|failed[^\n]*|timed out[^\n]*) in ([\d.]+)(ms|s):$"
DIFF_HEADER = r"(?md)^diff --git a/(.+?) b/(.+?)$"
HEREDOC = r"(?ds)(?:cat|tee)\s+(?:-a\s+)?>+\s*(?<path>[^\s<>|;&]+)\s*<<\s*[-]?\s*'?\"?(?<tag>[A-Za-z_][A-Za-z0-9_]*)'?\"?\s*\n(?<body>.*?)\n[ \t]*\k<tag>\b"
SHELL_WRITES = [
    ("heredoc", r"(?:cat|tee)\s+(?:-a\s+)?>+\s*(\S+)\s*<<"),
    ("py-open", r"open\(\s*['\"]([^'\"]+)['\"]\s*,\s*['\"][wa]"),
    ("py-write_text", r"Path\(\s*['\"]([^'\"]+)['\"]\s*\)\s*\.\s*write_text"),
    ("tee", r"\|\s*tee\s+(\S+)"),
    ("redirect", r"(?<![>\d])>\s*([^\s>|&;]+\.\w{1,5})\b"),
]
NETWORK = r"\b(curl|wget|requests\.(?:get|post)|urllib|httpx|http\.client)\b"
SUMMARY = r"(?mds)^\*\*(.+?)\*\*\n(.*?)(?=\n\*\*|\nexec\n|\napply patch\n|\z)"
#: Which parameter a timeline shows, by tool.
SHOWN = {"Bash": "command", "WebSearch": "query", "WebFetch": "url", "Write": "file_path", "Edit": "file_path", "Read": "file_path", "run_shell_command": "command", "google_web_search": "query", "web_fetch": "prompt", "write_file": "file_path", "replace": "file_path", "read_file": "file_path", "list_directory": "dir_path", "glob": "pattern", "grep_search": "pattern", "update_topic": "title"}


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    """A field of a VARIANT, null where it is absent or of another type."""
    return F.call_function("try_variant_get", F.col(v) if isinstance(v, str) else v, F.lit(path), F.lit(kind))


def json_lines(logs: DataFrame) -> DataFrame:
    """log_id, line, v for lines that are JSON objects; banners and broken lines go."""
    rows = logs.select("log_id", F.posexplode(F.split("body", r"\r?\n")).alias("line", "text"))
    return rows.where(F.startswith(F.ltrim("text"), F.lit("{"))).select("log_id", "line", F.expr("try_parse_json(trim(text))").alias("v")).where("v is not null")


def dialect(logs: DataFrame) -> DataFrame:
    """adds ``dialect`` from the first 16384 characters: the first JSON line's keys, else marks of plain text."""
    head = F.left("body", F.lit(16384))
    parsed = F.filter(F.transform(F.filter(F.split(head, r"\r?\n"), lambda x: F.startswith(F.ltrim(x), F.lit("{"))), lambda x: F.call_function("try_parse_json", F.trim(x))), lambda v: v.isNotNull())
    first = F.try_element_at(parsed, F.lit(1))
    has = lambda k: F.call_function("variant_get", F.col("_first"), F.lit(f"$.{k}"), F.lit("variant")).isNotNull()
    kind = F.coalesce(get("_first", "$.type"), F.lit(""))
    found = (
        F.when(has("thread_id") | kind.isin("thread.started", "turn.started", "turn.completed", "item.started", "item.completed"), "codex2")
        .when(has("message") | kind.isin("system", "assistant", "user", "result"), "claude")
        .when(has("tool_name") | has("tool_id") | has("session_id"), "gemini")
        .when(F.startswith(F.col("_head"), F.lit("Reading additional input from stdin")) | F.contains(F.left("_head", F.lit(400)), F.lit("OpenAI Codex v")) | F.col("_head").rlike(r"(?md)^exec\n(?:/bin/)?bash -lc? "), "codex")
        .when(F.col("_head").rlike(r"(?md)^(?:\S+ )?Tool call: \S+ \{") | F.contains("_head", F.lit("----- RAW stream-json -----")), "gemini")
        .otherwise("claude")
    )
    return logs.withColumns({"_head": head, "_first": first}).withColumn("dialect", found).drop("_head", "_first")


_EVENT = ["log_id", "seq", "kind", "name", "params", "result", "uid"]
_NONE = lambda kind: F.lit(None).cast(kind)


def last_by(rows: DataFrame, key: list[str], order: list[str], *values: str) -> DataFrame:
    """The last row's values for each key: how a later write replaces an earlier one."""
    return rows.groupBy(*key).agg(*(F.max_by(v, F.struct(*order)).alias(v) for v in values))


def claude_events(logs: DataFrame) -> DataFrame:
    """Tool uses with the last result of their id; assistant texts."""
    rows = json_lines(logs).select("log_id", "line", get("v", "$.type").alias("type"), F.posexplode(F.coalesce(get("v", "$.message.content", "array<variant>"), F.array().cast("array<variant>"))).alias("pos", "b"))
    at = F.struct("line", "pos").alias("seq")
    made = rows.where("type = 'assistant'")
    uses = made.where(get("b", "$.type") == "tool_use").select("log_id", at, F.coalesce(get("b", "$.name"), F.lit("")).alias("name"), F.to_json(F.coalesce(get("b", "$.input", "variant"), F.expr("parse_json('{}')"))).alias("params"), get("b", "$.id").alias("uid"))
    parts = get("b", "$.content", "array<variant>")
    text = F.when(parts.isNotNull(), F.array_join(F.transform(parts, lambda x: F.coalesce(get(x, "$.text"), F.lit(""))), " ")).otherwise(F.coalesce(get("b", "$.content"), F.lit("")))
    results = last_by(rows.where(F.col("type") == "user").where(get("b", "$.type") == "tool_result").select("log_id", "line", "pos", get("b", "$.tool_use_id").alias("uid"), text.alias("result")), ["log_id", "uid"], ["line", "pos"], "result")
    tools = uses.join(results, ["log_id", "uid"], "left").select("log_id", "seq", F.lit("tool").alias("kind"), "name", "params", F.coalesce("result", F.lit("")).alias("result"), "uid")
    texts = made.where(get("b", "$.type") == "text").select("log_id", at, F.lit("text").alias("kind"), F.lit("").alias("name"), F.lit("{}").alias("params"), F.coalesce(get("b", "$.text"), F.lit("")).alias("result"), _NONE("string").alias("uid"))
    return tools.unionByName(texts)


def gemini_events(logs: DataFrame) -> DataFrame:
    """The JSON tail behind the last mark or a bare JSON log; calls in prose if neither has objects."""
    pieces = F.split("body", RAW_MARK)
    tail = F.when(F.size(pieces) > 1, F.element_at(pieces, -1)).when(F.startswith(F.ltrim("body"), F.lit("{")), F.col("body"))
    split = logs.withColumn("tail", tail)
    objects = json_lines(split.where("tail is not null").select("log_id", F.col("tail").alias("body")))
    kind = get("v", "$.type")
    at = F.struct("line", F.lit(0).alias("pos")).alias("seq")
    output = F.coalesce(get("v", "$.output"), F.to_json(get("v", "$.output", "variant")), F.lit(""))
    results = last_by(objects.where(kind == "tool_result").select("log_id", "line", get("v", "$.tool_id").alias("uid"), output.alias("result")), ["log_id", "uid"], ["line"], "result")
    uses = objects.where(kind == "tool_use").select("log_id", at, F.coalesce(get("v", "$.tool_name"), F.lit("")).alias("name"), F.to_json(F.coalesce(get("v", "$.parameters", "variant"), F.expr("parse_json('{}')"))).alias("params"), get("v", "$.tool_id").alias("uid"))
    tools = uses.join(results, ["log_id", "uid"], "left").select("log_id", "seq", F.lit("tool").alias("kind"), "name", "params", F.coalesce("result", F.lit("")).alias("result"), "uid")
    said = get("v", "$.content")
    texts = objects.where((kind == "message") & (get("v", "$.role") == "assistant") & (F.coalesce(said, F.lit("")) != "")).select("log_id", at, F.lit("text").alias("kind"), F.lit("").alias("name"), F.lit("{}").alias("params"), said.alias("result"), _NONE("string").alias("uid"))
    prose = split.join(objects.select("log_id").distinct(), "log_id", "left_anti")
    chunks = F.filter(F.split("body", "(?=" + PROSE_CALL + ")"), lambda c: c.rlike("^(?:" + PROSE_CALL + ")"))
    calls = prose.select("log_id", F.posexplode(chunks).alias("i", "chunk"))
    raw = F.regexp_extract("chunk", PROSE_CALL, 2)
    params = F.coalesce(F.to_json(F.expr("try_parse_json(raw)")), F.to_json(F.struct(one_line(F.col("raw"), 400).alias("_raw"))))
    after = F.split("chunk", PROSE_RESULT, 2)
    spoken = calls.withColumn("raw", raw).select("log_id", F.struct(F.col("i").alias("line"), F.lit(0).alias("pos")).alias("seq"), F.lit("tool").alias("kind"), F.regexp_extract("chunk", PROSE_CALL, 1).alias("name"), params.alias("params"), F.when(F.size(after) > 1, F.regexp_replace(after[1], r"^\s+|\s+$", "")).otherwise("").alias("result"), F.concat(F.lit("gem-"), F.col("i").cast("string")).alias("uid"))
    return tools.unionByName(texts).unionByName(spoken)


def codex2_events(logs: DataFrame) -> DataFrame:
    """Completed items; a command keeps its start's text only where its own is absent."""
    rows = json_lines(logs).select("log_id", "line", get("v", "$.type").alias("type"), get("v", "$.item", "variant").alias("item")).where("item is not null")
    rows = rows.withColumns({"t": get("item", "$.type"), "uid": get("item", "$.id"), "command": get("item", "$.command")})
    started = last_by(rows.where("type = 'item.started' and t = 'command_execution'"), ["log_id", "uid"], ["line"], "command").withColumnRenamed("command", "started")
    done = rows.where(F.col("type") == "item.completed").where(F.col("t").isin("reasoning", "agent_message", "command_execution", "todo_list", "error")).join(started, ["log_id", "uid"], "left")
    command = F.coalesce("command", "started", F.lit(""))
    result = F.when(F.col("t") == "command_execution", get("item", "$.aggregated_output")).when(F.col("t") == "error", get("item", "$.message")).when(F.col("t") == "todo_list", F.to_json(F.coalesce(get("item", "$.items", "variant"), F.col("item")))).otherwise(get("item", "$.text"))
    kind = F.when(F.col("t").isin("reasoning", "agent_message"), "text").otherwise("tool")
    params = F.when(F.col("t") == "command_execution", F.to_json(F.struct(command.alias("command")))).otherwise("{}")
    return done.select("log_id", F.struct("line", F.lit(0).alias("pos")).alias("seq"), kind.alias("kind"), F.col("t").alias("name"), params.alias("params"), F.coalesce(result, F.lit("")).alias("result"), "uid")


def codex_blocks(logs: DataFrame) -> DataFrame:
    """L-P5, W2: blocks of a plain transcript: kind, command, directory, status, duration, output, paths."""
    segs = F.filter(F.split("body", BLOCK_SPLIT), lambda s: s.rlike(r"(?d)^(exec\n(?:/bin/)?bash -lc? |apply patch\npatch: )"))
    d = logs.select("log_id", F.posexplode(segs).alias("idx", "raw"))
    d = d.withColumns({"kind": F.when(F.startswith("raw", F.lit("exec\n")), "exec").otherwise("patch"), "body": F.regexp_replace("raw", r"^[^\n]*\n", "")})
    pieces = F.split("body", BLOCK_RESULT, 2)
    done = F.col("body").rlike(BLOCK_RESULT)
    before = pieces[0]
    d = d.withColumns({"before": before, "after": F.when(done, F.try_element_at(pieces, F.lit(2))).otherwise("")})
    # A command must end before the result line; otherwise it is the first line.
    ended = F.col("before").rlike(r"(?ds)^(.*?) in (/\S*)\n")
    command = F.when(ended, F.trim(F.regexp_extract("before", r"(?ds)^(.*?) in (/\S*)\n", 1))).otherwise(F.trim(F.substring_index("body", "\n", 1)))
    is_exec = F.col("kind") == "exec"
    return d.select(
        "log_id", "idx", "kind", "raw",
        F.when(is_exec, command).otherwise("").alias("cmd"),
        F.when(is_exec & ended, F.regexp_extract("before", r"(?ds)^(.*?) in (/\S*)\n", 2)).otherwise("").alias("cwd"),
        F.when(is_exec, F.coalesce(first_group(F.col("body"), BLOCK_RESULT), F.lit("no_result"))).when(F.contains("body", F.lit("patch: completed")), "completed").otherwise("unknown").alias("status"),
        F.when(is_exec & done, F.concat(F.regexp_extract("body", BLOCK_RESULT, 2), F.regexp_extract("body", BLOCK_RESULT, 3))).otherwise("").alias("dur"),
        F.when(is_exec, F.greatest(F.regexp_count("body", F.lit(BLOCK_RESULT)) - 1, F.lit(0))).otherwise(0).alias("extra_results"),
        F.when(is_exec, F.regexp_replace("after", r"^\n+|\n+$", "")).otherwise(F.col("body")).alias("output"),
        F.when(~is_exec, F.array_distinct(F.regexp_extract_all("body", F.lit(DIFF_HEADER), 2))).otherwise(F.array().cast("array<string>")).alias("paths"),
    )


def codex_events(logs: DataFrame) -> DataFrame:
    """Blocks as tool events (the index of the block orders and names them), and summaries as texts."""
    b = codex_blocks(logs)
    params = F.when(F.col("kind") == "exec", F.to_json(F.struct(F.col("cmd").alias("command"), "cwd", F.col("status").alias("_status"), F.col("dur").alias("_dur")))).otherwise(F.to_json(F.struct("paths", F.col("status").alias("_status"))))
    tools = b.select("log_id", F.struct(F.col("idx").alias("line"), F.lit(0).alias("pos")).alias("seq"), F.lit("tool").alias("kind"), F.when(F.col("kind") == "exec", "exec").otherwise("apply_patch").alias("name"), params.alias("params"), F.col("output").alias("result"), F.format_string("c%04d", "idx").alias("uid"))
    heads, texts = (F.regexp_extract_all("body", F.lit(SUMMARY), k) for k in (1, 2))
    said = logs.select("log_id", F.posexplode(F.zip_with(heads, texts, lambda h, t: F.concat(F.lit("**"), h, F.lit("**\n"), F.regexp_replace(t, r"^\s+|\s+$", "")))).alias("i", "result"))
    said = said.select("log_id", F.struct(F.col("i").alias("line"), F.lit(1).alias("pos")).alias("seq"), F.lit("text").alias("kind"), F.lit("").alias("name"), F.lit("{}").alias("params"), "result", _NONE("string").alias("uid"))
    return tools.unionByName(said)


_READERS = {"claude": claude_events, "gemini": gemini_events, "codex": codex_events, "codex2": codex2_events}


def tool_events(logs: DataFrame) -> DataFrame:
    """L-P1: canonical events of all logs, each read by its dialect.

    Logs are told apart once and written; each reader scans its own dialect's folder.
    """
    path = folder(logs.sparkSession)
    dialect(logs).write.partitionBy("dialect").parquet(path)
    known = logs.sparkSession.read.schema(StructType([*logs.schema.fields, StructField("dialect", StringType())])).parquet(path)
    parts = [read(known.where(F.col("dialect") == name)).select(*_EVENT).withColumn("dialect", F.lit(name)) for name, read in _READERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timeline(events: DataFrame) -> DataFrame:
    """Dense index over a log's tool events, and one short line on each."""
    key = F.try_element_at(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv]), F.col("name"))
    picks = {k: get(F.expr("try_parse_json(params)"), f"$.{k}") for k in sorted({*SHOWN.values()})}
    shown = F.coalesce(*(F.when(key == k, v) for k, v in picks.items()), picks["command"])
    paths = F.array_join(get(F.expr("try_parse_json(params)"), "$.paths", "array<string>"), ", ")
    shown = F.when(F.col("name") == "apply_patch", F.when(F.coalesce(paths, F.lit("")) != "", paths).otherwise("(no path)")).otherwise(shown)
    text = F.when(F.coalesce(shown, F.lit("")) != "", shown).when(F.col("dialect") == "codex2", F.col("result")).otherwise(F.col("params"))
    over = Window.partitionBy("log_id").orderBy("seq")
    return events.where("kind = 'tool'").select("log_id", (F.row_number().over(over) - 1).alias("idx"), "name", one_line(text).alias("shown"))


def assistant_text(events: DataFrame) -> DataFrame:
    """W3, L-P2: texts in order; in the delta dialect a run joins without a break and a tool event ends it."""
    order = Window.partitionBy("log_id").orderBy("seq")
    runs = events.withColumn("island", F.sum(F.when(F.col("kind") == "tool", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 'text'")
    pieces = runs.withColumn("island", F.when(F.col("dialect") == "gemini", F.struct("island", F.lit(-1).alias("line"), F.lit(-1).alias("pos"))).otherwise(F.struct("island", F.col("seq.line"), F.col("seq.pos"))))
    joined = pieces.groupBy("log_id", "dialect", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "result"))), lambda x: x["result"]), "").alias("text"))
    gap = F.when(F.col("dialect").isin("codex", "codex2"), "\n\n").otherwise("\n")
    rows = joined.groupBy("log_id", "dialect").agg(F.transform(F.array_sort(F.collect_list(F.struct("island", "text"))), lambda x: x["text"]).alias("texts"))
    return rows.select("log_id", F.concat_ws("", F.transform("texts", lambda t, i: F.when(i == 0, t).otherwise(F.concat(gap, t)))).alias("text"))


def write_events(events: DataFrame) -> DataFrame:
    """L-P3: W full writes, E edits, P patches and S writes whose content can't be known, in order."""
    p = F.expr("try_parse_json(params)")
    full = events.where(F.col("name").isin("Write", "write_file")).select("log_id", "seq", F.lit(0).alias("n"), F.lit("W").alias("event"), F.coalesce(get(p, "$.file_path"), F.lit("")).alias("path"), F.coalesce(get(p, "$.content"), F.lit("")).alias("text"), F.lit("").alias("new"), F.lit(False).alias("everywhere"), F.col("name").alias("channel"))
    edits = events.where(F.col("name").isin("Edit", "replace")).select("log_id", "seq", F.lit(0).alias("n"), F.lit("E").alias("event"), F.coalesce(get(p, "$.file_path"), F.lit("")).alias("path"), F.coalesce(get(p, "$.old_string"), F.lit("")).alias("text"), F.coalesce(get(p, "$.new_string"), F.lit("")).alias("new"), F.coalesce(get(p, "$.replace_all", "boolean"), get(p, "$.allow_multiple", "boolean"), F.lit(False)).alias("everywhere"), F.col("name").alias("channel"))
    patches = events.where("name = 'apply_patch'").select("log_id", "seq", F.posexplode(F.coalesce(get(p, "$.paths", "array<string>"), F.array().cast("array<string>"))).alias("n", "path"), F.lit("P").alias("event"), F.col("result").alias("text"), F.lit("").alias("new"), F.lit(False).alias("everywhere"), F.lit("apply_patch").alias("channel"))
    shell = events.where(F.col("name").isin("exec", "command_execution")).select("log_id", "seq", F.coalesce(get(p, "$.command"), F.lit("")).alias("cmd"))
    here = F.arrays_zip(F.regexp_extract_all("cmd", F.lit(HEREDOC), 1).alias("path"), F.regexp_extract_all("cmd", F.lit(HEREDOC), 3).alias("body"))
    shell = shell.withColumn("here", F.filter(here, lambda h: looks_like_path(h["path"])))
    inline = shell.select("log_id", "seq", F.posexplode("here").alias("n", "h")).select("log_id", "seq", "n", F.lit("W").alias("event"), F.col("h.path").alias("path"), F.col("h.body").alias("text"), F.lit("").alias("new"), F.lit(False).alias("everywhere"), F.lit("shell:heredoc").alias("channel"))
    named = lambda c: lambda x: F.struct(x.alias("path"), F.lit(f"shell:{c}").alias("channel"))
    blind = F.flatten(F.array(*[F.transform(F.regexp_extract_all("cmd", F.lit(rx), 1), named(c)) for c, rx in SHELL_WRITES]))
    blind = F.filter(blind, lambda b: looks_like_path(b["path"]) & ~F.array_contains(F.transform("here", lambda h: h["path"]), b["path"]))
    opaque = shell.select("log_id", "seq", F.posexplode(blind).alias("n", "b")).select("log_id", "seq", (F.col("n") + 1000).alias("n"), F.lit("S").alias("event"), F.col("b.path").alias("path"), F.lit("").alias("text"), F.lit("").alias("new"), F.lit(False).alias("everywhere"), F.col("b.channel").alias("channel"))
    out = full
    for more in (edits, patches.select(*full.columns), inline, opaque):
        out = out.unionByName(more)
    return out


def search_returns(events: DataFrame) -> DataFrame:
    """L-P4, F28, F29: queries and addresses with what came back; network commands where there is no search tool."""
    p = F.expr("try_parse_json(params)")
    cmd, prompt = F.coalesce(get(p, "$.command"), F.lit("")), F.coalesce(get(p, "$.prompt"), F.lit(""))
    named = F.when(F.col("name").isin("WebSearch", "WebFetch"), F.coalesce(get(p, "$.query"), get(p, "$.url"))).when(F.col("name") == "google_web_search", F.coalesce(get(p, "$.query"), F.lit(""))).when(F.col("name") == "web_fetch", F.coalesce(first_url(prompt), one_line(prompt, 200)))
    net = F.col("name").isin("exec", "command_execution") & cmd.rlike(NETWORK)
    rows = events.withColumn("_asked", F.when(net, F.coalesce(first_url(cmd), one_line(cmd, 300))).otherwise(named)).where(net | F.col("name").isin("WebSearch", "WebFetch", "google_web_search", "web_fetch"))
    return rows.select("log_id", "seq", F.when(F.col("name").isin("exec", "command_execution"), "exec:net").otherwise(F.col("name")).alias("kind"), F.col("_asked").alias("query"), "result")


def written_paths(writes: DataFrame) -> DataFrame:
    """Distinct paths of a log in order of first sight, with their channels."""
    return writes.where("path != ''").groupBy("log_id", "path").agg(F.min(F.struct("seq", "n")).alias("first"), F.array_sort(F.collect_set("channel")).alias("channels"))


def edited_files(writes: DataFrame) -> DataFrame:
    """W7, L-P7: each file after its last full write and the edits behind it, with a confidence.

    A fold over the file's edits: one row a file, in the JVM.  An empty old text puts
    the new one in front, or between all characters for an edit everywhere.
    """
    rows = writes.where(F.col("event").isin("W", "E"))
    item = F.struct(F.struct("seq", "n").alias("at"), "event", F.col("text").alias("old"), "new", "everywhere")
    files = rows.groupBy("log_id", "path").agg(F.array_sort(F.collect_list(item)).alias("steps"), F.array_sort(F.collect_set("channel")).alias("channels"))
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("missing"))

    def step(a: Column, s: Column) -> Column:
        at = F.instr(a["t"], s["old"])
        once = F.concat(F.substr(a["t"], F.lit(1), at - 1), s["new"], F.substr(a["t"], at + F.length(s["old"])))
        wide = F.replace(a["t"], s["old"], s["new"])
        empty = F.when(s["everywhere"], F.concat(s["new"], F.array_join(F.transform(F.split(a["t"], ""), lambda c: F.concat(c, s["new"])), ""))).otherwise(F.concat(s["new"], a["t"]))
        edited = F.when(s["old"] == "", empty).when(s["everywhere"], wide).otherwise(once)
        lost = (s["old"] != "") & (at == 0)
        return F.when(s["event"] == "W", F.struct(s["old"].alias("t"), F.lit(0).alias("missing"))).when(a["t"].isNull(), a).when(lost, F.struct(a["t"].alias("t"), (a["missing"] + 1).alias("missing"))).otherwise(F.struct(edited.alias("t"), a["missing"].alias("missing")))

    d = files.withColumn("end", F.aggregate("steps", start, step))
    known = F.coalesce(F.col("end.t"), F.lit("")) != ""
    return d.select("log_id", "path", F.when(known, F.col("end.t")).otherwise("").alias("text"), F.when(~known, "unavailable").when(F.col("end.missing") == 0, "exact").otherwise("partial").alias("confidence"), F.col("end.missing").alias("unmatched"), "channels")


# -- unified diffs -----------------------------------------------------------


HUNK = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"


def apply_diff(lines: Column, section: Column) -> Column:
    """L-P6: a file's lines after one file's diff: the struct (lines, differ: hunks whose old text differs, created).

    The diff is parsed into an array of hunks (first line, old lines, new lines), which are
    laid over the lines from the last to the first, so that earlier line numbers stay right.
    """

    def hunk(text: Column) -> Column:
        body = F.filter(F.slice(F.split(text, "\n"), 2, F.length(text) + 1), lambda x: ~F.startswith(x, F.lit("\\")))
        side = lambda sign: F.transform(F.filter(body, lambda x: F.substr(x, F.lit(1), F.lit(1)).isin(sign, " ", "")), lambda x: F.substr(x, F.lit(2)))
        many = F.regexp_extract(text, HUNK, 2)
        first = F.greatest(F.regexp_extract(text, HUNK, 1).cast("int") - 1, F.lit(0))
        return F.struct(first.alias("at"), F.when(many == "", 1).otherwise(many.cast("int")).alias("n"), side("-").alias("old"), side("+").alias("new"))

    def lay(state: Column, h: Column) -> Column:
        had = F.slice(state["lines"], h["at"] + 1, h["n"])
        rest = F.slice(state["lines"], h["at"] + h["n"] + 1, F.size(state["lines"]) + 1)
        return F.struct(F.concat(F.slice(state["lines"], F.lit(1), h["at"]), h["new"], rest).alias("lines"), (state["differ"] + F.when((h["n"] > 0) & (had != h["old"]), 1).otherwise(0)).alias("differ"))

    created = section.rlike(r"(?md)^--- /dev/null$")
    hunks = F.transform(F.filter(F.split(section, "(?md)(?=" + HUNK + ")"), lambda x: x.rlike(HUNK)), hunk)
    none = F.array().cast("array<string>")
    start = F.struct(F.when(created | lines.isNull(), none).otherwise(lines).alias("lines"), F.lit(0).alias("differ"))
    end = F.aggregate(F.reverse(hunks), start, lay)
    return F.struct(end["lines"].alias("lines"), end["differ"].alias("differ"), created.alias("created"))


def patched_files(writes: DataFrame) -> DataFrame:
    """L-P6, UD1, W16: files of the plain dialect after their full writes and diffs: a fold over a file's events, one row a file, in the JVM."""
    rows = writes.where(F.col("event").isin("W", "P", "S"))
    header = DIFF_HEADER.removeprefix("(?md)")
    sections = F.filter(F.split("text", "(?md)(?=" + header + ")"), lambda x: F.regexp_extract(x, r"\A(?md)" + header, 2) == F.col("path"))
    last = F.when(F.size(sections) > 0, F.element_at(sections, -1))  # a diff is printed twice; the last one counts
    item = F.struct(F.struct(F.col("seq.line").alias("line"), "n").alias("at"), "event", F.when(F.col("event") == "P", last).otherwise(F.col("text")).alias("text"))
    files = rows.select("log_id", "path", item.alias("item")).groupBy("log_id", "path").agg(F.array_sort(F.collect_list("item")).alias("steps"))
    state = lambda lines, differ, opaque, made: F.struct(lines.alias("lines"), differ.alias("differ"), opaque.alias("opaque"), made.alias("made"))
    zero, no = F.lit(0), F.lit(False)

    def step(was: Column, e: Column) -> Column:
        laid = apply_diff(was["lines"], e["text"])
        patched = state(laid["lines"], was["differ"] + laid["differ"], was["opaque"], was["made"] | laid["created"])
        blind = state(was["lines"], was["differ"], was["opaque"] + 1, was["made"])
        return F.when(e["event"] == "W", state(F.split(e["text"], "\n"), zero, zero, F.lit(True))).when(e["event"] == "S", blind).when(e["text"].isNull(), was).otherwise(patched)

    end = F.aggregate("steps", state(F.lit(None).cast("array<string>"), zero, zero, no), step)
    d = files.withColumn("end", end)
    exact = F.col("end.made") & (F.col("end.differ") == 0) & (F.col("end.opaque") == 0)
    confidence = F.when(F.col("end.lines").isNull(), "unavailable").when(exact, "exact").otherwise("partial")
    return d.select("log_id", "path", F.coalesce(F.array_join("end.lines", "\n"), F.lit("")).alias("text"), confidence.alias("confidence"), F.col("end.differ").alias("mismatches"), F.col("end.opaque").alias("opaque"))


def failure_status(logs: DataFrame) -> DataFrame:
    """L-P9: the error status of a session's last result line."""
    rows = json_lines(logs).where(get("v", "$.type") == "result")
    return rows.groupBy("log_id").agg(F.max_by(get("v", "$.api_error_status"), "line").alias("status"))
