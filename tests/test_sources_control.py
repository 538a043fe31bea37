import json
import threading
import time
import zipfile

import pytest

from pyspark.sql import functions as F

from tessera.operators import control, corpus
from tessera.sources import archives, files, sinks
from tessera.streaming import logs as streaming


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_analyses_and_source_sets(spark, tmp_path):
    for m, t in (("m1", "t1"), ("m1", "t2"), ("_batch", "t3")):
        put(tmp_path, f"corpus/{m}/{t}/analysis.md", f"{m} {t}\r\nx\u2028y")
    put(tmp_path, "sets.tsv", "task\tset\nt1\told\nshort\nt1\tnew\textra\n")
    rows = {(r.model, r.task): (r.source_set, r.body) for r in files.analyses(spark, str(tmp_path / "corpus"), str(tmp_path / "sets.tsv")).collect()}
    assert rows == {("m1", "t1"): ("new", "m1 t1\r\nx\u2028y"), ("m1", "t2"): ("unknown", "m1 t2\r\nx\u2028y")}


def test_trajectories(spark, tmp_path):
    put(tmp_path, "traj/a.json", json.dumps({"task_id": "a", "reason": "no_decision: x", "claude_log": "", "gemini_log": "abc"}))
    put(tmp_path, "traj/b.json", json.dumps({"task_id": "b", "codex_log": ""}))
    put(tmp_path, "traj/c.json", "{broken")
    rows = [(r.task_id, r.category, r.log_format, r.log_chars) for r in files.trajectories(spark, str(tmp_path)).collect()]
    assert rows == [("a", "no_decision", "gemini", 3), ("b", "soft", "codex", 0)]


def test_manifests_split_at_line_feeds_alone(spark, tmp_path):
    put(tmp_path, "m.jsonl", '{"work_id": "W1", "title": "a\u0085b"}\n\n{bad\n{"work_id": "W2"}\n')
    rows = files.json_lines(spark, str(tmp_path / "m.jsonl"), "work_id string, title string").orderBy("line").collect()
    assert [(r.work_id, r.title) for r in rows] == [("W1", "a\u0085b"), ("W2", None)]
    put(tmp_path, "topics.txt", "# c\n first \n\nsecond")
    assert [r.topic for r in files.topics(spark, str(tmp_path / "topics.txt")).orderBy("line").collect()] == ["first", "second"]


def test_papers_from_folder_and_zip(spark, tmp_path):
    blocks = [{"type": "text", "text": "Title of the paper", "text_level": 1}, {"type": "footer", "text": "no"}, {"type": "text", "text": "intro text"}, {"type": "text", "text": "2 Results", "text_level": 1}, {"type": "text", "text": "found it"}]
    put(tmp_path, "p/W1.mineru/auto/W1_content_list.json", json.dumps(blocks[:1]))
    put(tmp_path, "p/W1.mineru/vlm/W1_content_list.json", json.dumps(blocks))
    got = files.paper_blocks(spark, str(tmp_path / "p"))
    sections = {r.section: r.text for r in corpus.paper_sections(got).collect()}
    assert sections == {"Title of the paper": "intro text", "results": "found it"}
    titles = corpus.paper_titles(got)
    assert titles.head().title == "Title of the paper"
    assert corpus.narrative(corpus.paper_sections(got), titles).head().narrative == "## RESULTS\nfound it"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("W2.mineru/vlm/x_content_list.json", "[]")
        z.writestr("other.txt", "no")
    assert [r.member for r in archives.zip_members(spark, str(tmp_path / "a.zip")).collect()] == ["W2.mineru/vlm/x_content_list.json"]


def test_search_by_cursor(spark):
    pages = {"q1": [{"cursor": "*", "results": [{"id": "a"}, {"id": "b"}], "meta": {"next_cursor": "n"}}, {"cursor": "n", "results": [{"id": "c"}], "meta": {"next_cursor": None}}], "q2": []}
    rows = archives.search(spark, ["q1", "q2"], pages=json.dumps(pages), max_works="3").orderBy("rank").collect()
    assert [(r.query, r.rank, json.loads(r.work)["id"]) for r in rows] == [("q1", 1, "a"), ("q1", 2, "b"), ("q1", 3, "c")]
    assert archives.search(spark, ["q1"], pages=json.dumps(pages), max_works="2").count() == 2


def test_sampled_search_by_page_ranges(spark):
    pages = {"q1": [{"results": [{"id": f"{k}-{i}"} for i in range(3)]} for k in range(5)], "q2": [{"results": []}]}
    options = {"pages": json.dumps(pages), "sample": "true", "per_page": "3", "pages_per_partition": "2"}
    rows = archives.search(spark, ["q1", "q2"], max_works="13", **options)
    assert rows.rdd.getNumPartitions() == 6
    got = sorted((r.rank, json.loads(r.work)["id"]) for r in rows.collect())
    assert got == [(3 * k + i + 1, f"{k}-{i}") for k in range(5) for i in range(3) if 3 * k + i < 13]
    assert archives.search(spark, ["q1"], max_works="100", **options).count() == 15


def test_a_stopped_crawl_goes_on_where_it_was(spark, tmp_path):
    for k in range(1, 6):
        put(tmp_path, f"pages/q/{k}.json", json.dumps({"results": [{"id": f"{k}-{i}"} for i in range(2)]}))
    options = {"folder": f"{tmp_path}/pages", "per_page": "2", "max_works": "10", "pages_per_batch": "1"}

    def crawl(until):
        query = archives.search_stream(spark, ["q"], **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        end = time.time() + 60
        while time.time() < end and query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < until):
            time.sleep(0.2)
        query.stop()
        return {(r.rank, json.loads(r.work)["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    first = crawl(1)
    assert first >= {(1, "1-0"), (2, "1-1"), (3, "2-0"), (4, "2-1")}
    put(tmp_path, "pages/q/1.json", "{broken")  # is read no more
    rows = crawl(4)
    assert rows == {(2 * k + i - 1, f"{k}-{i}") for k in range(1, 6) for i in range(2)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_retries_wait_and_raise():
    calls = []

    def fails():
        calls.append(1)
        raise OSError("no")

    try:
        archives.retrying(fails, 3, 0)
    except OSError:
        pass
    assert len(calls) == 3


def test_signals_and_tiers(spark):
    work = {"id": "https://x/W9", "doi": "https://doi.org/10.1/z", "title": None, "display_name": "T", "fwci": 4.5, "authorships": [{"institutions": []}, {"institutions": [{"id": "https://x/I1", "display_name": "Lab"}]}], "primary_location": {"source": {"id": "https://x/S1", "display_name": "J", "type": "journal"}}}
    raw = spark.createDataFrame([(json.dumps(work),), (json.dumps({"id": "https://x/W8"}),)], "j string").select(F.from_json("j", corpus.WORK).alias("o")).select("o.*")
    metrics = spark.createDataFrame([("S1", 9.5, 10)], "id string, two_year_citedness double, h_index int")
    labs = spark.createDataFrame([("I1", 500)], "id string, h_index int")
    got = {r.work_id: r for r in corpus.tiered(corpus.enriched(corpus.signals(raw), metrics, labs)).collect()}
    assert got["W9"].tier == "golden" and got["W9"].weight == 4.0 and got["W9"].doi == "10.1/z" and got["W9"].title == "T"
    assert list(got["W9"].reasons) == ["fwci=4.5", "venue 2yr-citedness=9.5", "fwci=4.5 (field-leading)", "prominent group (Lab, h=500)"]
    assert got["W8"].tier == "bronze" and list(got["W8"].reasons) == []


def test_quotable_text(spark, tmp_path):
    put(tmp_path, "w1/report.md", "R")
    put(tmp_path, "w1/agent_code/a.py", "code")
    put(tmp_path, "w1/agent_code/big.py", b"x" * 2_000_001)
    put(tmp_path, "w2/agent_log.txt", "log")
    rows = {r.workspace: (r.quotable, r.artifact) for r in files.quotable(spark, str(tmp_path)).collect()}
    assert rows == {"w1": ("R\ncode", "R"), "w2": ("log", None)}


def test_passes_until_complete(spark, tmp_path):
    tasks = spark.createDataFrame([(f"k{i}", f"prompt {i}") for i in range(5)], "key string, prompt string")
    state = spark.createDataFrame([("k0", "done", 1, "ok")], "key string, status string, attempts int, reply string")
    answers = spark.createDataFrame([(f"prompt {i}", "ok" if i != 4 else "bad") for i in (1, 2, 4)], "prompt string, reply string")

    def keep(df, k):
        df.write.parquet(f"{tmp_path}/state{k}")
        return spark.read.parquet(f"{tmp_path}/state{k}")

    end = control.run_until_complete(tasks, state, lambda p: control.answer_table(p, answers), lambda r: r == "ok", keep, passes=4, most_attempts=2)
    got = {r.key: (r.status, r.attempts) for r in end.collect()}
    assert got == {"k0": ("done", 1), "k1": ("done", 1), "k2": ("done", 1), "k3": ("infra_error", 0), "k4": ("qa_fail", 2)}


def test_replies_are_read_as_json(spark):
    tasks = spark.createDataFrame([("a", "p1"), ("b", "p2")], "key string, prompt string")
    state = spark.createDataFrame([], "key string, status string, attempts int, reply string")
    answers = spark.createDataFrame([("p1", 'Sure: {"ok": "say "yes" now"} bye'), ("p2", "no object")], "prompt string, reply string")
    end = control.one_pass(tasks, state, lambda p: control.answer_table(p, answers), lambda r: r.contains("yes"), 2, as_json=True)
    got = {r.key: (r.status, r.reply) for r in end.collect()}
    assert got["a"] == ("done", r'{"ok":"say \"yes\" now"}') and got["b"][0] != "done" and got["b"][1] is None


def test_calls_in_a_window_with_growing_budgets(spark):
    def complete(ask):
        kind, _, n = ask.prompt.partition(" ")
        if kind == "bad":
            raise ValueError("no")
        if kind == "long" and ask.tokens < int(n):
            raise control.Truncated(f"at {ask.tokens}")
        if kind == "busy" and ask.attempt < int(n):
            raise OSError("http 529")
        return ask.prompt.upper()

    asked = [("ok", "ok"), ("bad", "bad"), ("l1", "long 20000"), ("l2", "long 60000"), ("l3", "long 99999"), ("b2", "busy 2"), ("b9", "busy 9"), ("none", None)]
    prompts = spark.createDataFrame(asked, "key string, prompt string").coalesce(1)
    rows = control.call_model(prompts, complete, at_once=3, sleep=lambda s: None).collect()
    assert [r.key for r in rows] == [k for k, _ in asked]
    got = {r.key: (r.reply, r.error, r.tries, r.tokens, r.waited) for r in rows}
    assert got == {
        "ok": ("OK", None, 1, 16000, 0.0), "bad": (None, "ValueError: no", 1, 16000, 0.0), "l1": ("LONG 20000", None, 2, 28800, 0.0), "l2": ("LONG 60000", None, 4, 64000, 0.0),
        "l3": (None, "truncated: at 64000", 4, 64000, 0.0), "b2": ("BUSY 2", None, 3, 16000, 6.0), "b9": (None, "transport: http 529", 4, 16000, 14.0), "none": ("", None, 1, 16000, 0.0),
    }


def test_windows_keep_order_and_bound():
    lock, now, most = threading.Lock(), [0], [0]

    def work(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 * (i % 7))
        with lock:
            now[0] -= 1
        return i

    taken = []

    def items():
        for i in range(60):
            taken.append(i)
            yield i

    results = control.in_window(items(), work, 5)
    assert next(results) == 0 and len(taken) <= 6  # read as far as the window, not further
    assert list(results) == list(range(1, 60)) and 1 < most[0] <= 5
    assert control.Budget(wait=2.0, most_wait=5.0).most_wait == 5.0
    pauses = []
    control.answered("x", lambda a: (_ for _ in ()).throw(OSError("x")), control.Budget(retries=4, most_wait=5.0), pauses.append)
    assert pauses == [2.0, 4.0, 5.0, 5.0]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("A.1", 3, 12.34, "a_b & 5%"), ("B.1", 0, None, None)], "code string, hits int, rate double, note string")
    assert sinks.markdown(frame).splitlines()[2] == "| A.1 | 3 | 12.3 | a_b & 5% |"
    assert r"a\_b \& 5\%" in sinks.latex(frame, "c")
    sinks.to_csv(frame, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    labels = spark.createDataFrame([("m", "t", "A.1", 2), ("m", "t", "B.2", 0)], "model string, task string, code string, score int")
    records = spark.createDataFrame([("m", "t"), ("m", "u")], "model string, task string")
    assert {r.task: json.loads(r.row) for r in sinks.grid_json(labels, records).collect()} == {"t": ["m", "t", {"A.1": 2}], "u": ["m", "u", {}]}


def test_logs_stream_once(spark, tmp_path):
    put(tmp_path, "in/a.log", json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "x", "name": "Bash", "input": {"command": "ls"}}]}}))
    for k in (1, 2):
        query = streaming.events_of_new_logs(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck")
        assert query.awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out").count() == k
        put(tmp_path, f"in/b{k}.log", json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "y", "name": "Read", "input": {"file_path": "f"}}]}}))


def test_pdf_and_paths(spark):
    row = spark.createDataFrame([(bytearray(b"%PDF-1.7 x"), bytearray(b"<html>"))], "a binary, b binary").select(corpus.pdf_ok(F.col("a")).alias("a"), corpus.pdf_ok(F.col("b")).alias("b")).head()
    assert row.a and not row.b


def test_lines_of_files_read_in_blocks_keep_their_numbers(spark, tmp_path):
    from tessera.sources import files

    texts = {"a.jsonl": [f'{{"n": {k}}}' for k in range(3000)], "b.jsonl": ["x\u0085y", "", "tail\r"], "c.jsonl": ["one"]}
    for name, rows in texts.items():
        (tmp_path / name).write_bytes(("\n".join(rows) + ("\n" if name == "a.jsonl" else "")).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = files.whole_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 0 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = {(r.path.rsplit("/", 1)[1], r.line): r.text for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(name, k): t for name, rows in texts.items() for k, t in enumerate(rows)}


def test_a_report_of_too_many_rows_is_an_error(spark):
    from tessera.sources import sinks

    with pytest.raises(ValueError):
        sinks.markdown(spark.range(11), 10)
    assert sinks.markdown(spark.range(2), 10).count("\n") == 4
