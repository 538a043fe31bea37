"""Files under names of their own as members of archives: a tree of any number of small files in few large ones.

A loose file takes a block of the disk, a folder another, and an entry in the driver's
listing.  Where there are millions, a tree is packed instead: a folder that ends in
``.pack`` holds gzipped tar archives, written by the tasks that have the rows and bounded
in members and bytes.  ``tar xzf`` gives the tree that ``write_named`` writes; ``read``
gives the members as rows.  What passes through the driver is one name an archive.

A name that stands twice is two members, as tar has it.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.sources.named_files import checked_name

SUFFIX = ".pack"
#: Members and bytes after which an archive ends, and rows and bytes of a batch that is read.
MOST_FILES, MOST_BYTES = 20_000, 32 << 20
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Zlib's fastest level: small files repeat each other's headers.
LEVEL = 1

_SCHEMA = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def place(root: str):
    """The store and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def split(path: str) -> tuple[str, str] | None:
    """A pack's folder and the path below it, of a path that lies in a pack."""
    head, found, below = (path.rstrip("/") + "/").partition(f"{SUFFIX}/")
    return (head + SUFFIX, below) if found else None


@dataclass
class Packed(WriterCommitMessage):
    """A task's archives in the staging folder."""

    names: list[str]


class PackWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), f"_staging-{uuid.uuid4().hex}"
        store, root = place(self.root)
        store.create_dir(f"{root}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        store, root = place(self.root)
        names: list[str] = []
        few = (b.slice(k, 100) for b in iterator for k in range(0, b.num_rows, 100))
        rows = ((checked_name(p), c.encode() if isinstance(c, str) else c or b"") for b in few for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        row = next(rows, None)
        while row:
            names.append(f"{uuid.uuid4().hex}.tar.gz")
            # The staging folder isn't made here: a task that outlives its job fails.
            with store.open_output_stream(f"{root}/{self.job}/{names[-1]}", compression=None) as out, tarfile.open(fileobj=out, mode="w|gz", compresslevel=LEVEL, format=tarfile.GNU_FORMAT) as archive:
                files = held = 0
                while row and files < MOST_FILES and held < MOST_BYTES:
                    info = tarfile.TarInfo(row[0])
                    info.size = len(row[1])
                    archive.addfile(info, io.BytesIO(row[1]))
                    files, held, row = files + 1, held + info.size, next(rows, None)
        return Packed(names)

    def commit(self, messages: list[Packed | None]) -> None:
        store, root = place(self.root)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        store.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[Packed | None]) -> None:
        store, root = place(self.root)
        store.delete_dir(f"{root}/{self.job}")


class Archive(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PackReader(DataSourceReader):
    def __init__(self, root: str, below: str, glob: str):
        self.root, self.below, self.glob = root, below, glob

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        store, root = place(self.root)
        return [Archive(f.base_name) for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".tar.gz")] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = place(self.root)
        paths: list[str] = []
        contents: list[bytes] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(map(len, contents), pa.int64()), pa.array(contents, pa.binary())], schema=_SCHEMA)

        with store.open_input_stream(f"{root}/{partition.name}", compression=None) as source, tarfile.open(fileobj=source, mode="r|gz") as archive:
            for info in archive:
                archive.members = []  # or the archive keeps a record of each
                if not info.size or not info.name.startswith(self.below) or not fnmatchcase(info.name.rpartition("/")[2], self.glob):
                    continue
                paths.append(f"{self.root}/{info.name}")
                contents.append(archive.extractfile(info).read())
                held += info.size
                if len(paths) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch()
                    paths, contents, held = [], [], 0
        if paths:
            yield batch()


class Packs(DataSource):
    """Rows (path, content) as members of the archives in the folder ``path``; read back as path, length and content, those ``below`` a path and with a name like ``glob``."""

    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema) -> PackReader:
        return PackReader(self.options["path"], self.options.get("below", ""), self.options.get("glob", "*"))

    def writer(self, schema, overwrite: bool) -> PackWriter:
        if overwrite:
            raise ValueError("a pack is added to, not overwritten")
        return PackWriter(self.options["path"])


def write(files: DataFrame, root: str) -> None:
    """Each row (path, content) as a member of the pack's archives; null content is an empty file."""
    if not root.endswith(SUFFIX):
        raise ValueError(f"a pack's folder ends in {SUFFIX}")
    files.sparkSession.dataSource.register(Packs)
    files.select("path", "content").write.format("packs").option("path", root).mode("append").save()


def read(spark: SparkSession, root: str, below: str = "", glob: str | None = None) -> DataFrame:
    """path, length, content of a pack's members; an empty file isn't a row, as with Spark's file sources."""
    spark.dataSource.register(Packs)
    return spark.read.format("packs").options(path=root, below=below, glob=glob or "*").load()
