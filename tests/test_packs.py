import os
import tarfile

import pytest

from tessera import plans, registry
from tessera.sources import files, packs, scratch

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string").repartition(3)


def test_a_pack_is_the_tree_that_loose_files_are(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t{packs.SUFFIX}"
    rows = [("a/b/c.txt", "é\n"), ("a/d", None), ("e.md", ""), ("x" * 120 + "/long.txt", "l")] + [(f"many/{i}.txt", str(i)) for i in range(200)]
    packs.write(frame(spark, rows), f"file://{root}")
    for name in os.listdir(root):
        with tarfile.open(f"{root}/{name}") as t:
            t.extractall(f"{tmp_path}/out", filter="data")
    assert {p: open(f"{tmp_path}/out/{p}", encoding="utf8").read() for p, _ in rows} == {p: c or "" for p, c in rows}
    got = {r.path: (r.size, r.body) for r in files.whole_files(spark, root).collect()}
    assert got == {f"{root}/{p}": (len(c.encode()), c) for p, c in rows if c}  # empty files aren't rows
    assert {r.body for r in files.whole_files(spark, f"{root}/many", "1?.txt").collect()} == {str(i) for i in range(10, 20)}
    packs.write(frame(spark, [("late", "x")]), root)
    assert files.whole_files(spark, root).count() == len(got) + 1


def test_archives_are_bounded(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packs, "MOST_FILES", 10)
    monkeypatch.setattr(packs, "MOST_BYTES", 100)
    writer = packs.PackWriter(f"{tmp_path}/t{packs.SUFFIX}")
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(35)]), pa.array(["x" * 200] + ["y"] * 34)], ["path", "content"])
    done = writer.write(iter([batch]))
    assert len(done.names) == 5  # one for its bytes, then ten each
    writer.commit([done, None])
    assert sorted(os.listdir(writer.root)) == sorted(done.names)
    reader = packs.PackReader(writer.root, "", "*")
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 35


def test_a_failed_pack_leaves_nothing(spark, tmp_path):
    root = f"{tmp_path}/t{packs.SUFFIX}"
    with pytest.raises(Exception, match="not a file's name"):
        packs.write(frame(spark, [("a", "1"), ("../outside", "x")]), root)
    assert os.listdir(root) == [] and packs.split("/x/y") is None and packs.split(f"{root}/a/b") == (root, "a/b/")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["K18_task_files", "S1_S2_J3_analyses", "S9_S10_paper_blocks", "S19_quotable_sources", "S16_U1_pattern_sets", "J1_classifications", "K19_workspaces", "K21_pattern_files", "S3_S4_P2_trajectories"])
def test_scratch_has_no_file_a_row(spark, name):
    """The driver lists, and the disk holds, archives by tasks and bytes."""
    assert plans
    before = len(scratch._MADE)
    rows = registry.QUERIES[name](spark, SF).count()
    there = sum(len(found) for _, path in scratch._MADE[before:] for _, _, found in os.walk(path.removeprefix("file://")))
    assert rows > 0 and 0 < there <= 40
