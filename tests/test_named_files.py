import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import templates
from tessera.sources import files, sinks
from tessera.sources.named_files import NamedFilesWriter, Staged, checked_name, write_named


def found(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names}


def frame(spark, rows, schema="path string, content string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_files_have_their_own_names(spark, tmp_path):
    rows = [("a/b/c.txt", "é\n"), ("a/d", None), ("e.md", "")] + [(f"many/{i}.txt", str(i)) for i in range(200)]
    write_named(frame(spark, rows), f"file://{tmp_path}/out")
    assert found(f"{tmp_path}/out") == {p: (c or "").encode() for p, c in rows}
    write_named(frame(spark, [("raw.bin", bytearray(b"\x00\xff"))], "path string, content binary"), f"{tmp_path}/out")
    assert found(f"{tmp_path}/out")["raw.bin"] == b"\x00\xff"
    write_named(frame(spark, []), f"{tmp_path}/none")
    assert found(f"{tmp_path}/none") == {}


def test_appending_refuses_and_overwriting_replaces(spark, tmp_path):
    root = f"{tmp_path}/out"
    write_named(frame(spark, [("a/x", "1"), ("b", "2")]), root)
    with pytest.raises(Exception, match="1 files are there"):
        write_named(frame(spark, [("b", "3"), ("c", "4")]), root)
    assert found(root) == {"a/x": b"1", "b": b"2"}
    write_named(frame(spark, [("b", "3"), ("a/y", "4")]), root, overwrite=True)
    assert found(root) == {"b": b"3", "a/y": b"4"}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = f"{tmp_path}/out"
    write_named(frame(spark, [("old", "1")]), root)
    rows = frame(spark, [(f"f{i}", str(i)) for i in range(50)] + [("../outside", "x")])
    for overwrite in (False, True):
        with pytest.raises(Exception, match="not a file's name"):
            write_named(rows, root, overwrite)
        assert found(root) == {"old": b"1"} and os.listdir(tmp_path) == ["out"] and os.listdir(root) == ["old"]
    with pytest.raises(Exception, match="two rows"):
        write_named(frame(spark, [("same", "1"), ("same", "2"), ("other", "3")]), root, overwrite=True)
    assert found(root) == {"old": b"1"} and os.listdir(root) == ["old"]


def test_only_the_try_that_counts_is_moved(tmp_path):
    """A task that ran twice has staged its files twice; the lost try's go with the staging folder."""
    writer = NamedFilesWriter(str(tmp_path), False)
    lost = writer.write(iter([("a", "lost"), ("b", "lost")]))
    kept = writer.write(iter([("a", "kept")]))
    assert lost.folder != kept.folder and not os.path.exists(tmp_path / "a")
    writer.commit([kept, None])
    assert found(tmp_path) == {"a": b"kept"} and os.listdir(tmp_path) == ["a"]
    second = NamedFilesWriter(str(tmp_path), True)
    done = second.write(iter([("c/d", "new")]))
    second.abort([done, None])
    assert found(tmp_path) == {"a": b"kept"} and os.listdir(tmp_path) == ["a"]


def test_a_commit_that_breaks_off_puts_all_back(tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x").write_text("1")
    writer = NamedFilesWriter(str(tmp_path), True)
    good = writer.write(iter([("old/y", "2")]))
    with pytest.raises(FileNotFoundError):
        writer.commit([good, Staged(f"{tmp_path}/{writer.job}/gone", ["z"])])
    assert found(tmp_path) == {"old/x": b"1"} and os.listdir(tmp_path) == ["old"]


@pytest.mark.parametrize("name", ["", "/a", "a//b", "..", "a/../b", "./a", "a/", "_staging-1/x", "a\0b", None])
def test_names_stay_below_the_root(name):
    with pytest.raises((ValueError, TypeError)):
        checked_name(name)


def test_task_directories(spark, tmp_path):
    gold = "struct<claim:string,value:double>"
    rows = [("t/1", "auc", ["auc", "f1"], "m", "gold", 2.5, True, "p", None, "c", ("said", 1e-7), [{"n": 1}]), ("", None, None, None, None, 0.0, None, None, "t", None, None, None)]
    tasks = spark.createDataFrame(rows, f"task_id string, handle string, all_handles array<string>, novelty_move string, tier string, tier_weight double, qe_ready boolean, premise string, tension string, conclusion string, gold {gold}, paper_gt array<map<string,int>>")
    ask = templates.compiled("# {t}\n{{x}}", {"t": F.col("task_id")})
    write_named(sinks.task_files(tasks.where("task_id <> ''"), ask).unionByName(sinks.dataset_files(spark, {"e.py": "pass"})), f"{tmp_path}/o")
    made = {k: v.decode() for k, v in found(f"{tmp_path}/o").items()}
    assert set(made) == {"t_1/task.toml", "t_1/instruction.md", "t_1/tests/task_meta.json", "dataset.toml", "tests/e.py"}
    assert 'instance_id = "t_1"\n' in made["t_1/task.toml"] and "tier_weight = 2.5\nqe_ready = true\n" in made["t_1/task.toml"]
    assert made["t_1/instruction.md"] == "# t/1\n{x}"
    meta = {"rubric": {"task_id": "t/1", "premise": "p", "tension": "", "paper_conclusion": "c", "novelty_move": "m", "observable": "auc", "all_observables": ["auc", "f1"], "gold": {"claim": "said", "value": 1e-7}, "paper_gt": [{"n": 1}], "tier": "gold", "tier_weight": 2.5, "qe_ready": True}}
    assert made["t_1/tests/task_meta.json"] == json.dumps(meta, indent=2, ensure_ascii=False)


def test_workspaces(spark, tmp_path):
    given = {"task_id": "t/2", "reward": 1, "reason": "ok", "gemini_log": "plain", "decision": {"observable": "é", "x": [1.5, None]}, "dims": {"a": 1}}
    (tmp_path / "traj").mkdir()
    (tmp_path / "traj" / "a.json").write_text(json.dumps(given))
    streams = spark.createDataFrame([("t/2", '{"type": "init"}')], "task_id string, stream string")
    made = {r.path: r.content for r in sinks.workspace_files(files.trajectories(spark, str(tmp_path)), streams).collect()}
    log = 'plain\n----- RAW stream-json -----\n{"type": "init"}'
    assert made["t_2/agent_log.txt"] == log and made["t_2/report.md"] == ""
    assert made["t_2/decision.json"] == json.dumps(given["decision"], indent=2, ensure_ascii=False)
    meta = json.loads(made["t_2/meta.json"])
    assert (meta["reward"], meta["dims"], meta["log_chars"], meta["observable_text"], meta["resource_monitor"]) == (1, {"a": 1}, len(log), "é", None)


def test_templates(spark):
    row = spark.createDataFrame([("{x}", None)], "a string, b string")
    fields = {"a": F.col("a"), "b": F.col("b")}
    assert row.select(templates.compiled("{{{a}}}|{b}|{a}", fields)).head()[0] == "{{x}}||{x}"
    for bad in ("{c} {a} {b}", "{a}", "{} {a} {b}", "{a!r} {b}", "{a:>3} {b}", "{a.x} {b}", "{a} {b} {"):
        with pytest.raises(ValueError):
            templates.compiled(bad, fields)
    assert {(r.version, r.text) for r in templates.rendered(row, {"1": "{a}{b}", "2": "-{b}{a}"}, fields, "a").collect()} == {("1", "{x}"), ("2", "-{x}")}


def test_pattern_files_and_status(spark):
    rows = [(2, "m1", ["a", "b"], "x" * 21), (1, "m2", ["b"], " short "), (3, "m1", [], None), (4, None, ["b"], "")]
    patterns = spark.createDataFrame(rows, "paper_id int, novelty_move string, handles array<string>, tension string")
    made = {r.path: r.content for r in sinks.pattern_files(patterns).unionByName(sinks.corpus_map(patterns)).collect()}
    assert made["patterns/2.json"] == json.dumps({"paper_id": 2, "novelty_move": "m1", "handles": ["a", "b"], "tension": "x" * 21}, indent=2)
    want = {"n_papers": 4, "move_distribution": {"m1": 2, "m2": 1}, "recompute_anchor_distribution": {"b": 3, "a": 1}, "n_with_nontrivial_tension": 1, "n_with_recompute_anchor": 3}
    assert made["corpus_map.json"] == json.dumps(want, indent=2)
    none = {r.path: r.content for r in sinks.corpus_map(patterns.where("false")).collect()}
    assert json.loads(none["corpus_map.json"]) == {"n_papers": 0, "move_distribution": {}, "recompute_anchor_distribution": {}, "n_with_nontrivial_tension": 0, "n_with_recompute_anchor": 0}
    tally = "model string, passing bigint, total bigint"
    assert sinks.status_report(spark.createDataFrame([("TOTAL", 2, 2), ("m", 2, 2)], tally))[1] == 0
    text, code = sinks.status_report(spark.createDataFrame([("TOTAL", 1, 2), ("m", 1, 2)], tally))
    assert code == 1 and text.splitlines()[2] == "| TOTAL | 1 | 2 |"


