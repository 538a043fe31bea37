"""A corpus that is changed in place: new files beside the old ones, then one atomic step.

``root/versions/<n>`` names the folder of version n.  A change writes a new folder and
then puts the next version's file under its name, which fails if another writer has been
there first.  A reader sees the old state or the new one, whatever breaks off; a writer
that comes second tries again on what the first has left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has published the version in between."""


class Corpus:
    """The versions below a root in any store with an exclusive rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.store = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """What has been published, in order."""
        at = self._path("versions")
        if not self.store.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in self.store.listStatus(at) if f.getPath().getName().isdigit())

    def _folder(self, version: int) -> str:
        stream = self.store.open(self._path(f"versions/{version}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, the last one's by default."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"no version {version if version is not None else ''} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{self._folder(known[-1] if version is None else version)}")

    def publish(self, rows: DataFrame, after: int) -> int:
        """Write ``rows`` as the version behind ``after`` (0: none yet); ``Conflict`` if that isn't the last one any more."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        try:
            self._name(folder, after)
        except Conflict:
            self.store.delete(self._path(folder), True)
            raise
        return after + 1

    def _name(self, folder: str, after: int) -> None:
        """The atomic step."""
        if (self.versions() or [0])[-1] != after:
            raise Conflict(f"version {after} isn't the last")
        self.store.mkdirs(self._path("versions"))
        made = self._path(f"versions/_{uuid.uuid4().hex}")
        out = self.store.create(made, False)
        out.write(bytearray(folder.encode()))
        out.close()
        context = self.hadoop.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(self.hadoop, "Options$Rename")
        # Without the option to overwrite, a name that is there makes this fail.
        options = self.spark.sparkContext._gateway.new_array(kind, 0)
        try:
            context.rename(made, self._path(f"versions/{after + 1}"), options)
        except Exception as e:
            self.store.delete(made, False)
            if after + 1 in self.versions():
                raise Conflict(f"version {after + 1} is there") from e
            raise

    def change(self, update: Callable[[DataFrame], DataFrame], tries: int = 3) -> int:
        """Publish ``update`` of the last version; done anew if another writer comes first, ``tries`` times."""
        for k in range(tries):
            last = (self.versions() or [0])[-1]
            try:
                return self.publish(update(self.read(last)), last)
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    def sweep(self, keep: int = 1) -> None:
        """Delete all versions but the last ``keep``, and folders that no version names; not while a writer is at work."""
        known = self.versions()
        for version in known[:-keep] if keep else []:
            self.store.delete(self._path(f"versions/{version}"), False)
        named = {self._folder(v) for v in self.versions()}
        for f in self.store.listStatus(self._path("")):
            if (name := f.getPath().getName()).startswith("data-") and name not in named:
                self.store.delete(f.getPath(), True)
