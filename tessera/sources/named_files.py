"""A sink for files with names of their own: one row a file, all there or none.

Spark's writers choose their files' names; tools that read ``<task>/task.toml`` need
theirs.  Each task writes below a staging folder of its job; when all have ended, the
driver moves the files to their names, as Spark's own committers do.  A second try of a
task stages its files anew, and only those of the try that counted are moved.  After a
failure the staging folder goes and nothing else has changed.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Files that the driver moves at once.
MOVERS = 16


def checked_name(name: str) -> str:
    """A path below the root: no empty, ``.`` or ``..`` parts, so none leads out of it; staging is none either."""
    parts = (name or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0].startswith("_staging-") or "\0" in name:
        raise ValueError(f"not a file's name below the root: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder and the names in it."""

    folder: str
    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.job = f"_staging-{uuid.uuid4().hex}"
        store, root = self._place()
        store.create_dir(f"{root}/{self.job}", recursive=True)

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def write(self, iterator: Iterator) -> Staged:
        store, root = self._place()
        folder, names, made = f"{root}/{self.job}/{uuid.uuid4().hex}", set(), set()
        # No folder is made together with those above it: a task that still runs when its job
        # has failed finds the staging folder gone, and fails as well.
        store.create_dir(folder, recursive=False)
        for row in iterator:
            name, content = checked_name(row[0]), row[1]
            if name in names:
                raise ValueError(f"two rows for {name!r}")
            names.add(name)
            at = f"{folder}/{name}"
            for k in [i for i, c in enumerate(name) if c == "/"]:
                if name[:k] not in made:
                    store.create_dir(f"{folder}/{name[:k]}", recursive=False)
                    made.add(name[:k])
            with store.open_output_stream(at) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Staged(folder, sorted(names))

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = self._place()
        staged = [(m.folder, name) for m in messages if m for name in m.names]
        moved: list[str] = []
        aside: list[str] = []
        try:
            names = [name for _, name in staged]
            if twice := [n for n, k in Counter(names).items() if k > 1]:
                raise ValueError(f"two rows for one file, as {twice[0]!r}")
            if self.overwrite:
                store.create_dir(f"{root}/{self.job}/_old", recursive=True)
                for old in store.get_file_info(fs.FileSelector(root)):
                    if not old.base_name.startswith("_staging-"):
                        store.move(old.path, f"{root}/{self.job}/_old/{old.base_name}")
                        aside.append(old.base_name)
            elif found := [n for n in names if store.get_file_info(f"{root}/{n}").type != fs.FileType.NotFound]:
                raise FileExistsError(f"{len(found)} files are there, as {found[0]!r}")
            for above in sorted({f"{root}/{n}".rpartition("/")[0] for n in names}):
                store.create_dir(above, recursive=True)

            def move(pair: tuple[str, str]) -> None:
                store.move(f"{pair[0]}/{pair[1]}", f"{root}/{pair[1]}")
                moved.append(pair[1])

            with ThreadPoolExecutor(MOVERS) as movers:
                list(movers.map(move, staged))
        except BaseException:
            for name in moved:
                store.delete_file(f"{root}/{name}")
            for name in aside:
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.Directory:
                    store.delete_dir(f"{root}/{name}")  # folders made for the new files
                store.move(f"{root}/{self.job}/_old/{name}", f"{root}/{name}")
            raise
        finally:
            self._sweep(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._sweep(*self._place())

    def _sweep(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    """Rows (path, content) as files below the option ``path``; ``append`` refuses names that are there, ``overwrite`` clears the folder first."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        kinds = [f.dataType.simpleString() for f in schema.fields]
        if len(kinds) != 2 or kinds[0] != "string" or kinds[1] not in ("string", "binary"):
            raise ValueError("named files are rows of a path and a string or binary content")
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(files: DataFrame, root: str, overwrite: bool = False) -> None:
    """Each row (path, content) as the file ``root/path``; null content is an empty file.

    Files are written where their rows are.  The store is any that driver and executors share.
    """
    files.sparkSession.dataSource.register(NamedFiles)
    rows = files.select("path", "content")
    rows.write.format("named_files").option("path", root).mode("overwrite" if overwrite else "append").save()


def read_named(files: DataFrame, root: str) -> DataFrame:
    """``whole_files`` below a root as (path, content), paths relative to it."""
    tail = root.rstrip("/").rpartition("/")[2]
    return files.select(F.substring_index("path", f"/{tail}/", -1).alias("path"), F.col("body").alias("content"))
