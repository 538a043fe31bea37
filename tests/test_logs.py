"""Literal logs of every dialect against results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import logs as L

CLAUDE = "\n".join(json.dumps(x) for x in [
    {"type": "system"},
    {"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "a", "name": "Bash", "input": {"command": "ls\n-l"}}, {"type": "tool_use", "id": "b", "name": "Write", "input": {"file_path": "x.py", "content": "one\ntwo two"}}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "a", "content": [{"text": "p"}, {"text": "q"}]}, {"type": "tool_result", "tool_use_id": "orphan", "content": "lost"}]}},
    {"type": "user", "message": {"content": "plain words"}},
    {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "c", "name": "Edit", "input": {"file_path": "x.py", "old_string": "two", "new_string": "2"}}, {"type": "tool_use", "id": "d", "name": "WebSearch", "input": {"query": "q1"}}, {"type": "tool_use", "id": "e", "name": "Edit", "input": {"file_path": "x.py", "old_string": "absent", "new_string": "z"}}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "d", "content": "first"}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "d", "content": "found"}]}},
    {"type": "result", "api_error_status": "529"},
]) + "\n{broken"
GEMINI = "noise\n----- RAW stream-json -----\nold\n----- RAW stream-json -----\n" + "\n".join(json.dumps(x) for x in [
    {"type": "message", "role": "assistant", "content": "ab"}, {"type": "message", "role": "assistant", "content": "cd"},
    {"type": "tool_use", "tool_id": "1", "tool_name": "web_fetch", "parameters": {"prompt": "see https://e.org/x) now"}}, {"type": "tool_result", "tool_id": "1", "output": {"k": 1}},
    {"type": "message", "role": "assistant", "content": "ef"}, {"type": "message", "role": "user", "content": "no"},
    {"type": "tool_use", "tool_id": "2", "tool_name": "write_file", "parameters": {"file_path": "r.md", "content": "aXbX"}}, {"type": "tool_use", "tool_id": "3", "tool_name": "replace", "parameters": {"file_path": "r.md", "old_string": "X", "new_string": "-", "allow_multiple": True}},
])
PROSE = '2020 Tool call: run_shell_command {"command": "ls"}\nTool result (run): out1\n\nTool call: glob {bad\nTool result (glob): out2\n'
CODEX2 = "banner\n" + "\n".join(json.dumps(x) for x in [
    {"type": "thread.started", "thread_id": "t"}, {"type": "item.started", "item": {"id": "i1", "type": "command_execution", "command": "curl http://a.b/c"}}, {"type": "item.completed", "item": {"id": "i1", "type": "command_execution", "aggregated_output": "OUT"}},
    {"type": "item.completed", "item": {"id": "i2", "type": "agent_message", "text": "done"}}, {"type": "item.completed", "item": {"id": "i3", "type": "todo_list", "items": [1]}}, {"type": "item.completed", "item": {"id": "i5", "type": "error", "message": "boom"}},
    {"type": "item.completed", "item": {"id": "i4", "type": "command_execution", "command": "cat > a/b.txt <<'EOF'\nhello\nEOF\necho 1 > 0.99; echo z > out.log"}},
])
DIFF = "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,2 @@\n a\n-b\n+B\n"
CODEX = "OpenAI Codex v1\nexec\nbash -lc 'cat > f.py <<EOF\na\nb\nEOF' in /w\n succeeded in 12ms:\nok\n\nexec\nbash -lc 'wget https://u.v/w' in /w\n exited 1 in 1.5s:\nerr\n succeeded in 3ms:\nlate\napply patch\npatch: completed\nf.py\n" + DIFF + DIFF + "\n**Head**\nbody text\n"


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame([("c", CLAUDE), ("g", GEMINI), ("p", PROSE), ("k", CODEX), ("k2", CODEX2), ("none", "")], "log_id string, body string").cache()


@pytest.fixture(scope="module")
def events(logs):
    return L.tool_events(logs).cache()


def test_dialects(logs):
    assert {r.log_id: r.dialect for r in L.dialect(logs).collect()} == {"c": "claude", "g": "gemini", "p": "gemini", "k": "codex", "k2": "codex2", "none": "claude"}


def test_timelines(events):
    got = [(r.log_id, r.idx, r.name, r.shown) for r in L.timeline(events).orderBy("log_id", "idx").collect()]
    assert got[:5] == [("c", 0, "Bash", "ls -l"), ("c", 1, "Write", "x.py"), ("c", 2, "Edit", "x.py"), ("c", 3, "WebSearch", "q1"), ("c", 4, "Edit", "x.py")]
    assert ("g", 0, "web_fetch", "see https://e.org/x) now") in got and ("p", 0, "run_shell_command", "ls") in got
    assert ("k", 2, "apply_patch", "f.py") in got and ("k2", 0, "command_execution", "curl http://a.b/c") in got


def test_pairs(events):
    got = {(r.log_id, r.uid): r.result for r in events.where("kind = 'tool'").collect()}
    assert got["c", "a"] == "p q" and got["c", "b"] == "" and got["c", "d"] == "found" and ("c", "orphan") not in got
    assert got["g", "1"] == '{"k":1}' and got["p", "gem-0"] == "out1" and got["p", "gem-1"] == "out2"
    assert got["k", "c0000"] == "ok" and got["k2", "i1"] == "OUT" and got["k2", "i5"] == "boom"


def test_assistant_text(events):
    got = {r.log_id: r.text for r in L.assistant_text(events).collect()}
    assert got == {"c": "hi", "g": "abcd\nef", "k": "**Head**\nbody text", "k2": "done"}


def test_writes_and_files(events):
    writes = L.write_events(events)
    seen = [(r.log_id, r.event, r.path, r.channel) for r in writes.orderBy("log_id", "seq", "n").collect()]
    assert ("k2", "W", "a/b.txt", "shell:heredoc") in seen and ("k2", "S", "out.log", "shell:redirect") in seen
    assert not any(p == "0.99" or (e == "S" and p == "a/b.txt") for _, e, p, _ in seen)
    files = {(r.log_id, r.path): (r.text, r.confidence, r.unmatched) for r in L.edited_files(writes).collect()}
    assert files["c", "x.py"] == ("one\n2 two", "partial", 1) and files["g", "r.md"] == ("a-b-", "exact", 0)
    patched = L.patched_files(writes.where("log_id = 'k'")).collect()
    # The blank line behind a hunk's last line feed counts as context, so it differs and stays.
    assert [(r.path, r.text, r.confidence, r.mismatches) for r in patched] == [("f.py", "a\nB\n\n", "partial", 1)]


def test_searches_and_failures(logs, events):
    got = {(r.log_id, r.kind, r.query) for r in L.search_returns(events).collect()}
    assert got == {("c", "WebSearch", "q1"), ("g", "web_fetch", "https://e.org/x"), ("k", "exec:net", "https://u.v/w"), ("k2", "exec:net", "http://a.b/c")}
    assert [(r.log_id, r.status) for r in L.failure_status(logs).collect()] == [("c", "529")]


def test_blocks(logs):
    rows = L.codex_blocks(logs.where("log_id = 'k'")).orderBy("idx").collect()
    assert [(r.kind, r.cwd, r.status, r.dur, r.extra_results) for r in rows] == [("exec", "/w", "succeeded", "12ms", 0), ("exec", "/w", "exited 1", "1.5s", 1), ("patch", "", "completed", "", 0)]
    assert list(rows[2].paths) == ["f.py"]


def test_hunks_run_backwards_and_count_mismatches(spark):
    """Line numbers refer to the old file; a blank line is context, also the one behind a hunk's last line feed."""
    section = "--- a/f\n+++ b/f\n@@ -1 +1,2 @@\n-a\n+a1\n+a2\n@@ -3,1 +4,1 @@\n-c\n+C\n@@ -9,1 +9,1 @@\n-x\n+y"
    rows = [(0, ["a", "b", "c"], section), (1, ["a", "b"], "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n a\n-b\n+B"), (2, ["old"], "--- /dev/null\n+++ b/f\n@@ -0,0 +1,2 @@\n+n1\n+n2"), (3, None, "@@ -1 +1 @@\n-a\n+b\n\\ No newline"), (4, ["k"], "no hunks")]
    got = spark.createDataFrame(rows, "id int, lines array<string>, section string").select("id", L.apply_diff(F.col("lines"), F.col("section")).alias("d")).orderBy("id").collect()
    assert [tuple(r.d) for r in got] == [(["a1", "a2", "", "b", "C", "", "y"], 3, False), (["a", "B"], 0, False), (["n1", "n2"], 0, True), (["b"], 1, False), (["k"], 0, False)]


def test_empty_old_text(spark):
    rows = [("l", {"line": 0, "pos": 0}, 0, "W", "f", "ab", "", False, "Write"), ("l", {"line": 1, "pos": 0}, 0, "E", "f", "", ">", False, "Edit")]
    schema = "log_id string, seq struct<line: int, pos: int>, n int, event string, path string, text string, new string, everywhere boolean, channel string"
    assert L.edited_files(spark.createDataFrame(rows, schema)).head().text == ">ab"
