"""Log dialects, model replies and gates over all conversations, documents and parts.

Each conversation is a log: user turns are calls, the assistant turn behind one is its
result, a system turn is what stands before.  The number of the conversation gives the
dialect.  The SQL states what each reader has to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import replies
from tessera.operators import documents as D
from tessera.operators import logs as L
from tessera.operators import predicates as P
from tessera.registry import query, table
from tessera.sources.scratch import folder


def _json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items())))


def turn_() -> Column:
    return F.col("turn")


def text_() -> Column:
    return F.col("text")


def key_() -> Column:
    """A turn's number as text."""
    return turn_().cast("string")


def before_() -> Column:
    return (turn_() - 1).cast("string")


def flat_() -> Column:
    """A turn's text on one line."""
    return F.replace("text", F.lit("\n"), F.lit(" "))


def kind_() -> Column:
    """Which of four tools a turn takes."""
    return F.floor(turn_() / 2) % 4


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def bodies(rows: DataFrame, line: Column, head: str = "") -> DataFrame:
    """A log a conversation: its turns' lines in order, those that are null left out."""
    lines = F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("turn", line.alias("line"))))), lambda x: x["line"])
    return rows.groupBy(F.col("conv_id").cast("string").alias("log_id")).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("body"))


def by_role(user: Column, assistant: Column, system: Column) -> Column:
    return F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(system)


def claude(rows: DataFrame) -> DataFrame:
    """Four tools in turn; results come in two parts; a system turn is a banner."""
    path = text("f", (turn_() % 2).cast("string"), ".py")
    use = lambda name, params: F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), text("t", key_()).alias("text"))), F.to_variant_object(F.struct(F.lit("tool_use").alias("type"), key_().alias("id"), F.lit(name).alias("name"), params.alias("input")))).alias("content")).alias("message")))
    user = F.when(kind_() == 0, use("Bash", F.struct(flat_().alias("command")))).when(kind_() == 1, use("Write", F.struct(path.alias("file_path"), text_().alias("content")))).when(kind_() == 2, use("Edit", F.struct(path.alias("file_path"), F.lit("e").alias("old_string"), text("E", key_()).alias("new_string")))).otherwise(use("WebSearch", F.struct(flat_().alias("query"))))
    result = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), before_().alias("tool_use_id"), F.array(F.struct(text_().alias("text")), F.struct(F.lit("end").alias("text"))).alias("content"))).alias("content")).alias("message")))
    return bodies(rows.where("conv_id % 5 = 0"), by_role(user, result, F.lit("banner {")))


def gemini(rows: DataFrame) -> DataFrame:
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), key_().alias("tool_id"), F.lit("web_fetch").alias("tool_name"), F.struct(text("see https://e.org/", key_(), " now").alias("prompt")).alias("parameters")))
    return bodies(rows.where("conv_id % 5 = 1"), by_role(use, _json(type="tool_result", tool_id=before_(), output=text_()), _json(type="message", role="assistant", content=text_())), "prose before\n----- RAW stream-json -----\n")


def prose(rows: DataFrame) -> DataFrame:
    return bodies(rows.where("conv_id % 5 = 2"), by_role(text("Tool call: run_shell_command ", _json(command=flat_())), text("Tool result (run): ", flat_(), " "), F.lit("note")))


def codex(rows: DataFrame) -> DataFrame:
    """Commands that write a file each; every third fails, every fifth has a second result line; a system turn is a summary."""
    status = F.when(turn_() % 3 == 0, " exited 1").otherwise(" succeeded")
    result = text(status, " in ", key_(), "ms:\n", text_(), F.when(turn_() % 5 == 0, "\n succeeded in 3ms:\nlate").otherwise(""))
    return bodies(rows.where("conv_id % 5 = 3"), by_role(text("exec\nbash -lc 'echo ", key_(), " > out", (turn_() % 3).cast("string"), ".log' in /w"), result, text("**Plan**\n", text_())), "OpenAI Codex v1\n")


def codex2(rows: DataFrame) -> DataFrame:
    """Commands are started by the user's turn and completed by the assistant's, or a message is all that comes."""
    item = lambda **fields: F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))
    start = _json(type="item.started", item=item(id=key_(), type="command_execution", command=text("curl http://h.org/", key_(), " | head")))
    done = F.when(turn_() % 3 == 0, _json(type="item.completed", item=item(id=key_(), type="agent_message", text=text_()))).otherwise(_json(type="item.completed", item=item(id=before_(), type="command_execution", aggregated_output=text_())))
    return bodies(rows.where("conv_id % 5 = 4"), by_role(start, done, _json(type="thread.started", thread_id="t")))


def all_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    out = claude(rows)
    for make in (gemini, prose, codex, codex2):
        out = out.unionByName(make(rows))
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    all_logs(spark, sf_dir).write.parquet(path)
    return L.tool_events(spark.read.parquet(path))


# What the logs hold: calls with the answer of the next turn, texts, and where they stand.
_T = """t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, replace(coalesce(text, ''), chr(10), ' ') AS flat, conv_id % 5 AS d, turn // 2 % 4 AS k,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS spot, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations),
    c AS (SELECT u.*, a.text AS answer, a.turn AS later, a.spot AS later_at FROM t u LEFT JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
    path AS (SELECT conv_id, turn, 'f' || turn % 2 || '.py' AS path, 'bash -lc ''echo ' || turn || ' > out' || turn % 3 || '.log''' AS shell FROM t),
    events AS (
      SELECT conv_id, spot AS line, 0 AS pos, 'text' AS kind, '' AS name, '{}' AS params, 't' || turn AS result, NULL AS uid, 'claude' AS dialect, turn FROM c WHERE d = 0
      UNION ALL SELECT c.conv_id, spot, 1, 'tool', ['Bash', 'Write', 'Edit', 'WebSearch'][k + 1], CASE k WHEN 0 THEN to_json({'command': flat}) WHEN 1 THEN to_json({'content': text, 'file_path': path}) WHEN 2 THEN to_json({'file_path': path, 'new_string': 'E' || c.turn, 'old_string': 'e'}) ELSE to_json({'query': flat}) END,
        CASE WHEN answer IS NULL THEN '' ELSE answer || ' end' END, c.turn::VARCHAR, 'claude', c.turn FROM c JOIN path p ON p.conv_id = c.conv_id AND p.turn = c.turn WHERE d = 0
      UNION ALL SELECT conv_id, spot + 1, 0, 'tool', 'web_fetch', '{"prompt":"see https://e.org/' || turn || ' now"}', coalesce(answer, ''), turn::VARCHAR, 'gemini', turn FROM c WHERE d = 1
      UNION ALL SELECT conv_id, spot + 1, 0, 'text', '', '{}', text, NULL, 'gemini', turn FROM t WHERE d = 1 AND role = 'system' AND text <> ''
      UNION ALL SELECT conv_id, nth, 0, 'tool', 'run_shell_command', to_json({'command': flat}), trim(coalesce(replace(answer, chr(10), ' '), '')), 'gem-' || nth, 'gemini', turn FROM c WHERE d = 2
      UNION ALL SELECT c.conv_id, nth, 0, 'tool', 'exec', '{"command":"' || shell || CASE WHEN later IS NULL THEN ' in /w' ELSE '' END || '","cwd":"' || CASE WHEN later IS NULL THEN '' ELSE '/w' END || '","_status":"' || CASE WHEN later IS NULL THEN 'no_result' WHEN later % 3 = 0 THEN 'exited 1' ELSE 'succeeded' END || '","_dur":"' || coalesce(later || 'ms', '') || '"}',
        CASE WHEN later IS NULL THEN '' ELSE trim(answer || CASE WHEN later % 5 = 0 THEN chr(10) || ' succeeded in 3ms:' || chr(10) || 'late' ELSE '' END, chr(10)) END, 'c' || lpad(nth::VARCHAR, 4, '0'), 'codex', c.turn FROM c JOIN path p ON p.conv_id = c.conv_id AND p.turn = c.turn WHERE d = 3
      UNION ALL SELECT conv_id, 0, 1, 'text', '', '{}', '**Plan**' || chr(10) || trim(text, ' ' || chr(10) || chr(9)), NULL, 'codex', turn FROM t WHERE d = 3 AND role = 'system'
      UNION ALL SELECT conv_id, later_at, 0, 'tool', 'command_execution', '{"command":"curl http://h.org/' || turn || ' | head"}', answer, turn::VARCHAR, 'codex2', turn FROM c WHERE d = 4 AND later % 3 <> 0
      UNION ALL SELECT conv_id, spot, 0, 'text', 'agent_message', '{}', text, turn::VARCHAR, 'codex2', turn FROM t WHERE d = 4 AND role = 'assistant' AND turn % 3 = 0)"""


@query("L_P1_J4_J5_tool_events", f"WITH {_T} SELECT conv_id::VARCHAR AS log_id, line, pos, kind, name, params, result, uid, dialect FROM events", longs=("line", "pos"))
def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("log_id", "seq.line", "seq.pos", "kind", "name", "params", "result", "uid", "dialect")


@query("W1_F31_F32_timelines", f"""WITH {_T} SELECT e.conv_id::VARCHAR AS log_id, row_number() OVER (PARTITION BY e.conv_id ORDER BY line, pos) - 1 AS idx, name,
    replace(left(CASE name WHEN 'Write' THEN path WHEN 'Edit' THEN path WHEN 'web_fetch' THEN 'see https://e.org/' || e.turn || ' now' WHEN 'exec' THEN shell || CASE WHEN a.there IS NULL THEN ' in /w' ELSE '' END WHEN 'command_execution' THEN 'curl http://h.org/' || e.turn || ' | head' ELSE CASE WHEN t.flat = '' THEN params::VARCHAR ELSE t.flat END END, 160), chr(10), ' ') AS shown
    FROM events e JOIN path USING (conv_id, turn) JOIN t USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn - 1 AS turn, 1 AS there FROM t WHERE role = 'assistant') a USING (conv_id, turn) WHERE kind = 'tool'""", longs=("idx",))
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.timeline(events(spark, sf_dir))


@query("L_P2_W3_texts", f"""WITH {_T}, said AS (SELECT conv_id, list(result ORDER BY line, pos) AS l FROM events WHERE kind = 'text' GROUP BY 1)
    SELECT conv_id::VARCHAR AS log_id, CASE WHEN conv_id % 5 >= 3 THEN array_to_string(l, chr(10) || chr(10)) ELSE array_to_string(l, chr(10)) END AS text FROM said""")
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.assistant_text(events(spark, sf_dir))


@query("L_P3_W15_written_paths", f"""WITH {_T} SELECT conv_id::VARCHAR AS log_id, path, string_agg(DISTINCT name, ' ' ORDER BY name) AS channels FROM events JOIN path USING (conv_id, turn) WHERE name IN ('Write', 'Edit') GROUP BY conv_id, path
    UNION ALL SELECT DISTINCT conv_id::VARCHAR, 'out' || turn % 3 || '.log', 'shell:redirect' FROM events WHERE name = 'exec'""")
def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.written_paths(L.write_events(events(spark, sf_dir))).select("log_id", "path", F.array_join("channels", " ").alias("channels"))


@query("L_P4_F28_F29_searches", f"""WITH {_T} SELECT conv_id::VARCHAR AS log_id, CASE name WHEN 'command_execution' THEN 'exec:net' ELSE name END AS kind, CASE name WHEN 'WebSearch' THEN flat WHEN 'web_fetch' THEN 'https://e.org/' || turn ELSE 'http://h.org/' || turn END AS query, result
    FROM events JOIN t USING (conv_id, turn) WHERE name IN ('WebSearch', 'web_fetch', 'command_execution')""")
def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search_returns(events(spark, sf_dir)).drop("seq")


@query("L_P7_W7_edited_files", f"""WITH {_T}, steps AS (SELECT e.conv_id, path, list({{'w': name = 'Write', 'text': t.text, 'new': 'E' || e.turn, 't': NULL::VARCHAR, 'lost': 0}} ORDER BY line, pos) AS s, string_agg(DISTINCT name, ' ' ORDER BY name) AS channels FROM events e JOIN path USING (conv_id, turn) JOIN t USING (conv_id, turn) WHERE name IN ('Write', 'Edit') GROUP BY 1, 2),
    ended AS (SELECT *, list_reduce([{{'w': false, 'text': '', 'new': '', 't': NULL::VARCHAR, 'lost': 0}}] || s, lambda a, b: {{'w': false, 'text': '', 'new': '', 't': CASE WHEN b.w THEN b.text WHEN a.t IS NULL THEN NULL WHEN instr(a.t, 'e') = 0 THEN a.t ELSE left(a.t, instr(a.t, 'e') - 1) || b.new || substr(a.t, instr(a.t, 'e') + 1) END,
      'lost': CASE WHEN b.w THEN 0 WHEN a.t IS NOT NULL AND instr(a.t, 'e') = 0 THEN a.lost + 1 ELSE a.lost END}}) AS e FROM steps)
    SELECT conv_id::VARCHAR AS log_id, path, coalesce(e.t, '') AS text, CASE WHEN coalesce(e.t, '') = '' THEN 'unavailable' WHEN e.lost = 0 THEN 'exact' ELSE 'partial' END AS confidence, e.lost AS unmatched, channels FROM ended""", longs=("unmatched",))
def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edited_files(L.write_events(events(spark, sf_dir))).withColumn("channels", F.array_join("channels", " "))


# -- diffs: the file is created from the first turn, each later one puts its first line in place of the first --


def diff_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each third conversation the diffs name a line that isn't there."""
    from pyspark.sql import Window

    rows, order = turns(spark, sf_dir), Window.partitionBy("conv_id").orderBy("turn")
    first = lambda c: F.substring_index(c, "\n", 1)
    rows = rows.withColumns({"place": F.row_number().over(order), "was": first(F.lag("text").over(order))})
    lines = F.split("text", "\n")
    made = text("--- /dev/null\n+++ b/f.py\n@@ -0,0 +1,", F.size(lines).cast("string"), " @@\n", F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"))
    changed = text("--- a/f.py\n+++ b/f.py\n@@ -1,1 +1,1 @@\n-", F.when(F.col("conv_id") % 3 == 0, "not there").otherwise(F.col("was")), "\n+", first(text_()))
    diff = text("apply patch\npatch: completed\nf.py\ndiff --git a/f.py b/f.py\n", F.when(F.col("place") == 1, made).otherwise(changed))
    return bodies(rows, diff, "OpenAI Codex v1\n")


@query("L_P6_UD1_W16_patched_files", """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    f AS (SELECT conv_id, any_value(n) AS n, string_split(arg_min(text, turn), chr(10)) AS lines, string_split(arg_max(text, turn), chr(10))[1] AS last FROM t GROUP BY 1)
    SELECT conv_id::VARCHAR AS log_id, 'f.py' AS path, CASE WHEN n = 1 THEN array_to_string(lines, chr(10)) ELSE array_to_string([last] || list_transform(range(n - 2), lambda i: '') || lines[2:] || [''], chr(10)) END AS text,
      CASE WHEN n > 2 OR (n = 2 AND conv_id % 3 = 0) THEN 'partial' ELSE 'exact' END AS confidence, CASE WHEN n < 2 THEN 0 WHEN conv_id % 3 = 0 THEN n - 1 ELSE n - 2 END AS mismatches, 0::BIGINT AS opaque FROM f""", longs=("mismatches", "opaque"))
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank line behind a hunk counts as context, so all but the last later hunk differ."""
    return L.patched_files(L.write_events(L.tool_events(diff_logs(spark, sf_dir))))


@query("L_P5_codex_blocks", f"""WITH {_T} SELECT conv_id::VARCHAR AS log_id, nth AS idx, 'exec' AS kind, CASE WHEN later IS NULL THEN '' ELSE '/w' END AS cwd, CASE WHEN later IS NULL THEN 'no_result' WHEN later % 3 = 0 THEN 'exited 1' ELSE 'succeeded' END AS status, coalesce(later || 'ms', '') AS dur, CASE WHEN later % 5 = 0 THEN 1 ELSE 0 END AS extra_results FROM c WHERE d = 3""", longs=("idx", "extra_results"))
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.codex_blocks(codex(turns(spark, sf_dir))).select("log_id", "idx", "kind", "cwd", "status", "dur", "extra_results")


@query("L_P9_S6_failure_status", "SELECT conv_id::VARCHAR AS log_id, CASE WHEN max(turn) % 4 <> 3 THEN (500 + max(turn))::VARCHAR END AS status FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns are results with a status, every fourth without; the others are broken or no results."""
    result = F.when(turn_() % 4 == 3, _json(type="result")).otherwise(_json(type="result", api_error_status=(turn_() + 500).cast("string")))
    return L.failure_status(bodies(turns(spark, sf_dir), by_role(F.lit('{"type": "result", broken'), result, _json(type="system"))))


# -- gates ------------------------------------------------------------------


_GATED = """g AS (SELECT doc_id, doc_id % 30 AS r, doc_id % 3 = 0 AS thin, length(coalesce(text, '')) AS n FROM documents)"""


@query("T1_document_gate", f"""WITH {_GATED} SELECT doc_id::VARCHAR AS path, thin, CASE WHEN doc_id % 4 = 0 THEN 3 WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS issues,
    CASE WHEN r < CASE WHEN thin THEN 7 ELSE 12 END THEN 'checklist too few rows: ' || r || ' < ' || CASE WHEN thin THEN 7 ELSE 12 END END AS checklist FROM g""", longs=("issues",))
def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with markers of three families and a checklist: rows and markers are counted, whatever else the gate finds."""
    key = F.col("doc_id")
    markers = F.when(key % 4 == 0, "1. one\n**2.** two\n\u246c three\n").when(key % 4 == 1, "- [12] one\n").otherwise("none\n")
    # Letters alone, so that no text has a marker or a table of its own.
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L} ]", " ")
    body = text("## Core Verdict\n", markers, "x ", plain, "\n## Sentence-by-Sentence Checklist\n", F.repeat(F.lit("| row |\n"), (key % 30).cast("int")))
    none = F.lit(None).cast("string")
    given = table(spark, sf_dir, "documents").select(key.cast("string").alias("path"), body.alias("body"), F.when(key % 3 == 0, "timeout").alias("reason"), none.alias("quotable"), none.alias("artifact"))
    gate = D.document_gate(given)
    return gate.select("path", "thin", F.col("issues").alias("issues"), F.try_element_at(F.filter("problems", lambda p: F.startswith(p, F.lit("checklist too"))), F.lit(1)).alias("checklist"))


@query("T2_classification_gate", """SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 IN (1, 4) THEN 0 ELSE 1 END AS n_labels, CASE doc_id % 7 WHEN 0 THEN 'A.1' WHEN 5 THEN 'A.1' WHEN 6 THEN 'A.1' ELSE '' END AS codes, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'partials is not a list; hits[0] invalid code Z.9; no hits/partials but a severity is given (expected ''none'')'
      WHEN 3 THEN 'hits[0] invalid code Q.7; no hits/partials but a severity is given (expected ''none'')' WHEN 4 THEN 'no hits/partials but a severity is given (expected ''none'')' WHEN 5 THEN 'HIT codes asserted but overall_severity=''none''' ELSE 'empty summary' END AS problems, doc_id % 7 = 0 AS ok FROM documents""", longs=("n_labels",))
def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classification a document, in seven states."""
    k = F.col("doc_id") % 7
    hit = lambda code: f'{{"code": "{code}", "confidence": 0.5, "evidence": "Section C, issue 8 is bad"}}'
    body = lambda hits, partials="[]", severity="high", summary="s": f'{{"task_id": "t", "overall_severity": "{severity}", "summary": "{summary}", "hits": [{hits}], "partials": {partials}}}'
    states = [body(hit("A.1")), "{x", body('{"code": "Z.9"}', "{}"), body(hit("Q.7")), body(""), body(hit("A.1"), severity="none"), body(hit("A.1"), summary=" ")]
    given = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.element_at(F.array(*map(F.lit, states)), (k + 1).cast("int")).alias("body"))
    return D.classification_gate(given).withColumns({c: F.array_join(c, "; ") for c in ("codes", "problems")})


@query("F1_F2_UD2_model_replies", r"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, to_json(replace(left(coalesce(text, ''), 60), '"', '')) AS s FROM documents)
    SELECT doc_id, CASE k WHEN 5 THEN NULL WHEN 3 THEN '{"a":"to \"no effect\" - but ' || s[2:-1] || '","n":[1,2]}' ELSE '{"a":' || s || ',"n":[1,2]}' END AS json FROM d""".replace("s[2:-1]", "substr(s, 2, length(s) - 2)"))
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply a document: plain, fenced, in prose, with bare inner quotes, with raw line breaks, and broken."""
    return spoken(spark, sf_dir).select("doc_id", F.to_json(replies.extract_json(F.col("reply"))).alias("json"))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, said = F.col("doc_id") % 6, F.replace(F.left(F.coalesce("text", F.lit("")), F.lit(60)), F.lit('"'), F.lit(""))
    plain = F.to_json(F.struct(said.alias("a"), F.array(F.lit(1), F.lit(2)).alias("n")))
    bare = F.substring(F.to_json(F.array(said)), 3, 10_000)
    bare = F.left(bare, F.length(bare) - 2)
    reply = (
        F.when(k == 0, plain).when(k == 1, text("Here:\n```json\n", plain, "\n```\nbye")).when(k == 2, text("I think ", plain, " and no {\"b\": 2}"))
        .when(k == 3, text('{"a": "to "no effect" - but ', bare, '", "n": [1, 2]}')).when(k == 4, text('{"a": "', F.replace(said, F.lit("\\"), F.lit("\\\\")), '", "n": [1, 2]}')).otherwise(text('{"a": "', bare))
    )
    return table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))


@query("F3_fenced_json", """SELECT doc_id, CASE WHEN k = 3 THEN NULL ELSE '{"a":{"b":' || doc_id || '}}' END AS lazy, CASE WHEN k IN (1, 3) THEN NULL ELSE '{"a":{"b":' || doc_id || '}}' END AS greedy FROM (SELECT doc_id, doc_id % 4 AS k FROM documents)""")
def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of fences: the first object, or all from the first brace to the last."""
    k = F.col("doc_id") % 4
    body = text('{"a": {"b": ', F.col("doc_id").cast("string"), "}}")
    said = F.when(k == 0, text("a ```json\n", body, "\n``` b")).when(k == 1, text("```\n", body, "\n```\n```{\"y\": 2}```")).when(k == 2, text("say ", body, " end")).otherwise("} {")
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(replies.fenced_json(said)).alias("lazy"), F.to_json(replies.fenced_json(said, True)).alias("greedy"))


@query("P12_phonon_chain", "SELECT p_partkey, p_size % 4 = 1 AND p_size % 3 <> 0 AS phonon FROM part")
def phonon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a part's steps: a key of the phonon code counts at the top level only."""
    size, one = F.col("p_size"), lambda k: F.create_map(F.lit(k), F.lit("1"))
    last = F.when(size % 4 == 1, one("tr2_ph")).when(size % 4 == 2, one("INPUTPH.tr2_ph")).otherwise(one("ecutwfc"))
    steps = F.when(size % 3 == 0, F.array(one("SYSTEM.ecutwfc"))).otherwise(F.array(one("SYSTEM.ecutwfc"), last))
    return table(spark, sf_dir, "part").select("p_partkey", P.phonon_chain(steps).alias("phonon"))


@query("P22_task_meta", """SELECT p_partkey::VARCHAR AS task_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS tension, p_brand AS premise, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS conclusion, '' AS novelty_move, CASE WHEN p_size % 5 = 0 THEN p_type ELSE 'site_preference' END AS recompute_handle,
    CASE WHEN p_size % 4 = 0 THEN p_brand ELSE '' END AS gold, CASE WHEN p_size % 7 = 0 THEN 'S' WHEN p_size % 4 = 0 THEN 'A' ELSE 'B' END AS tier, p_size % 6 = 0 AS unverified FROM part""")
def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, some = F.col("p_size"), lambda n, c: F.when(F.col("p_size") % n == 0, F.col(c) if isinstance(c, str) else c)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("task_id"), some(2, "p_name").alias("tension"), F.col("p_brand").alias("premise"), some(3, "p_type").alias("conclusion"), F.lit(None).cast("string").alias("novelty_move"), some(5, "p_type").alias("handle"), some(4, "p_brand").alias("gold"), F.when(size % 7 == 0, "S").when(size % 7 == 1, "").alias("tier"), F.when(size % 6 == 0, True).when(size % 6 == 1, False).alias("unverified"))
    return P.task_meta(rows)


@query("J16_known_fields", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'facet' ELSE '' END || CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN ' ' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'miller' ELSE '' END AS kept FROM part")
def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    given = F.create_map(F.lit("junk"), F.lit("1"), F.lit("facet"), F.lit("111"), F.lit("miller"), F.lit("1"))
    known = F.concat(F.when(size % 2 == 0, F.array(F.lit("facet"))).otherwise(F.array().cast("array<string>")), F.when(size % 3 == 0, F.array(F.lit("miller"), F.lit("smearing"))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(P.known_fields(given, known))), " ").alias("kept"))
