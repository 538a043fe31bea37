import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.sources.snapshots import Conflict, Corpus


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def held(corpus, version=None):
    return sorted(r.v for r in corpus.read(version).collect())


def test_versions(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/c")
    with pytest.raises(FileNotFoundError):
        corpus.read()
    assert corpus.versions() == [] and corpus.publish(rows(spark, 1, 2), 0) == 1
    assert corpus.change(lambda df: df.withColumn("v", F.col("v") * 10)) == 2
    assert held(corpus) == [10, 20] and held(corpus, 1) == [1, 2]
    with pytest.raises(FileNotFoundError):
        corpus.read(3)
    corpus.sweep()
    assert corpus.versions() == [2] and held(corpus) == [10, 20]
    assert len([f for f in os.listdir(tmp_path / "c") if f.startswith("data-")]) == 1


def test_a_second_writer_loses_or_tries_again(spark, tmp_path):
    corpus, other = (Corpus(spark, f"file://{tmp_path}/c") for _ in range(2))
    corpus.publish(rows(spark, 1), 0)
    with pytest.raises(Conflict):
        corpus.publish(rows(spark, 9), 0)
    assert held(corpus) == [1] and len([f for f in os.listdir(tmp_path / "c") if f.startswith("data-")]) == 1
    calls = []

    def update(df):
        calls.append(1)
        if len(calls) == 1:  # the other one publishes while this one works
            other.change(lambda d: d.withColumn("v", F.col("v") + 100))
        return df.withColumn("v", F.col("v") + 1)

    assert corpus.change(update) == 3 and len(calls) == 2 and held(corpus) == [102]
    # Between the check and the rename, too.
    corpus.versions = lambda: [1, 2]
    corpus.store.mkdirs(corpus._path("data-x"))
    with pytest.raises(Exception):  # noqa: B017  the name is there
        corpus._name("data-x", 2)
    assert held(other) == [102]


def test_readers_see_the_old_state_if_a_writer_breaks_off(spark, tmp_path, monkeypatch):
    corpus = Corpus(spark, f"file://{tmp_path}/c")
    corpus.publish(rows(spark, 1), 0)

    def stop(self, folder, after):
        raise RuntimeError("lost between writing and publishing")

    monkeypatch.setattr(Corpus, "_name", stop)
    with pytest.raises(RuntimeError):
        corpus.change(lambda df: df.withColumn("v", F.col("v") + 1))
    assert held(corpus) == [1] and corpus.versions() == [1]
    monkeypatch.undo()
    assert corpus.change(lambda df: df.withColumn("v", F.col("v") + 1)) == 2 and held(corpus) == [2]
    corpus.sweep(keep=2)
    assert corpus.versions() == [1, 2] and held(corpus, 1) == [1]


def test_backfill_ends_alike_after_a_crash(spark, tmp_path, monkeypatch):
    patterns, sidecar = Corpus(spark, f"file://{tmp_path}/p"), Corpus(spark, f"file://{tmp_path}/s")
    patterns.publish(spark.createDataFrame([("W1", "a"), ("10.1_X_Y", "b"), ("W2", "c"), (None, "d")], "stem string, title string"), 0)
    resolved = spark.createDataFrame([("W1", "golden", 4.0, ["r"]), ("10.1/X_Y", "silver", 2.0, [])], "key string, tier string, weight double, reasons array<string>")
    change = Corpus.change
    monkeypatch.setattr(Corpus, "change", lambda self, update, tries=3: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        C.backfill_tiers(patterns, sidecar, resolved)
    assert patterns.versions() == [1] and sidecar.versions() == [1]
    monkeypatch.setattr(Corpus, "change", change)
    for version in (2, 3):  # and twice gives the same
        C.backfill_tiers(patterns, sidecar, resolved)
        got = {r.title: (r.tier, r.tier_weight, r.tier_reasons) for r in patterns.read().collect()}
        assert got == {"a": ("golden", 4.0, ["r"]), "b": ("silver", 2.0, []), "c": ("bronze", 1.0, ["not found"]), "d": ("bronze", 1.0, ["not found"])}
        assert patterns.versions()[-1] == version and sidecar.read().count() == 2
