"""A folder of its own, deleted at the process's end, in the store that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, suffix: str = "") -> str:
    """A fresh path below the session's ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}{suffix}"
    _MADE.append((spark, path))
    return path


def put(spark: SparkSession, root: str, files: dict[str, str]) -> str:
    """Write small named texts below a root, in whatever store it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, text in files.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(text.encode()))
        out.close()
    return root


def remove() -> None:
    """Delete all folders made so far."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended already
            return


atexit.register(remove)
