"""Python data sources: members of zip archives, and paged metadata search.

Both are DataSources, so Spark plans their partitions; the search takes any page
function, which tests and offline runs replace by stored pages.
"""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def zip_members(spark: SparkSession, path: str, suffix: str = "content_list.json") -> DataFrame:
    """(archive, member, body) of the members with a suffix; archives are read where Spark's reader finds them."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if n.endswith(suffix))
                    for k in range(0, len(names), 50):
                        yield pd.DataFrame([(archive, n, z.read(n).decode("utf-8", "replace")) for n in names[k : k + 50]], columns=["archive", "member", "body"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, "archive string, member string, body string")


class Query(InputPartition):
    """A query from its first page on by cursor, or its pages ``first`` to ``last`` by number."""

    def __init__(self, text: str, first: int = 0, last: int = 0):
        self.text, self.first, self.last = text, first, last


class _Pages:
    """What both readers know of the options."""

    def __init__(self, options: dict):
        self.options = options
        self.queries = json.loads(options["queries"])
        self.most, self.per_page = int(options.get("max_works", 200)), int(options.get("per_page", 50))
        self.last = -(-self.most // self.per_page)

    def ranges(self, text: str, first: int, last: int) -> list[Query]:
        """Pages first to last as partitions of ``pages_per_partition``."""
        step = int(self.options.get("pages_per_partition", 4))
        return [Query(text, k, min(k + step - 1, last)) for k in range(first, last + 1, step)]

    def numbered(self, part: Query) -> Iterator[tuple]:
        fetch = _page_function(self.options)
        for number in range(part.first, part.last + 1):
            found = fetch(part.text, None, number).get("results") or []
            for i, work in enumerate(found[: self.per_page], (number - 1) * self.per_page + 1):
                if i <= self.most:
                    yield part.text, i, json.dumps(work)
            if not found:
                return


class _SearchReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Query]:
        if self.options.get("sample", "false") == "true":
            return [r for q in self.queries for r in self.ranges(q, 1, self.last)]
        return [Query(q) for q in self.queries]

    def read(self, partition: Query) -> Iterator[tuple]:
        if partition.first:
            yield from self.numbered(partition)
            return
        fetch, cursor, seen = _page_function(self.options), "*", 0
        while cursor and seen < self.most:
            page = fetch(partition.text, cursor, None)
            for work in (page.get("results") or [])[: self.most - seen]:
                seen += 1
                yield partition.text, seen, json.dumps(work)
            cursor = (page.get("meta") or {}).get("next_cursor") if page.get("results") else None


class _SearchStream(_Pages, DataSourceStreamReader):
    """Pages by number as a stream: the offset is how many pages of each query are done, so a crawl that was stopped goes on there."""

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.queries, 0)

    def latestOffset(self) -> dict:
        step = int(self.options.get("pages_per_batch", self.last))
        self.reached = {q: min(n + step, self.last) for q, n in getattr(self, "reached", self.initialOffset()).items()}
        return self.reached

    def partitions(self, start: dict, end: dict) -> list[Query]:
        # After a restart the stream's own start counts, not this reader's.
        self.reached = {q: max(self.reached[q] if hasattr(self, "reached") else 0, end.get(q, 0)) for q in self.queries}
        return [r for q in self.queries for r in self.ranges(q, start.get(q, 0) + 1, end.get(q, 0))]

    def read(self, partition: Query) -> Iterator[tuple]:
        yield from self.numbered(partition)


class WorksSearch(DataSource):
    """(query, rank, work), ranked or sampled.

    Ranked (by ``sort``) follows cursors, a partition a query.  With ``sample`` true the works
    are a random sample of ``max_works`` by ``seed``, whose pages have numbers: a partition
    takes ``pages_per_partition`` of them.  As a stream, always by number, a batch takes
    ``pages_per_batch`` of each query.  Options: ``queries`` (a JSON list), ``max_works``,
    ``per_page``, and ``pages`` (a JSON object of query to stored pages), ``folder``
    (``<folder>/<query>/<page>.json``), or ``url`` with ``sort``, ``filter``, ``api_key``,
    ``mailto``.
    """

    @classmethod
    def name(cls) -> str:
        return "works_search"

    def schema(self) -> str:
        return "query string, rank int, work string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SearchStream(dict(self.options))


def retrying(call: Callable[[], dict], tries: int = 4, wait: float = 1.0) -> dict:
    """A call with exponential waiting between failures; the last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


def _page_function(options: dict) -> Callable[[str, str | None, int | None], dict]:
    """A page of a query by its cursor or by its number."""
    if "pages" in options:
        stored = json.loads(options["pages"])
        return lambda query, cursor, number: next((p for k, p in enumerate(stored.get(query, []), 1) if (k == number if number else p.get("cursor", "*") == cursor)), {})
    if "folder" in options:
        from pyarrow import fs

        root = options["folder"].rstrip("/")
        store, at = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)

        def read(query: str, cursor: str | None, number: int | None) -> dict:
            name = f"{at}/{query}/{number or ('1' if cursor == '*' else cursor)}.json"
            if store.get_file_info(name).type == fs.FileType.NotFound:
                return {}
            with store.open_input_stream(name) as f:
                return json.loads(f.read())

        return read

    def fetch(query: str, cursor: str | None, number: int | None) -> dict:
        from urllib.parse import urlencode
        from urllib.request import urlopen

        shared = {k: options[k] for k in ("api_key", "mailto") if k in options} | {"per-page": options.get("per_page", "50")}
        if number:
            wanted = ",".join(filter(None, [f"default.search:{query}", options.get("filter")]))
            params = {"filter": wanted, "sample": options.get("max_works", "200"), "seed": options.get("seed", "13"), "page": number}
        else:
            params = {"search": query, "cursor": cursor} | {k: options[k] for k in ("sort", "filter") if k in options}
        page = retrying(lambda: json.load(urlopen(f"{options['url']}?{urlencode(params | shared)}", timeout=20)))
        time.sleep(float(options.get("pause", 0.12)))
        return page

    return fetch


def search(spark: SparkSession, queries: list[str], **options: str) -> DataFrame:
    """Works by query, in rank order within each."""
    spark.dataSource.register(WorksSearch)
    return spark.read.format("works_search").options(queries=json.dumps(queries), **options).load()


def search_stream(spark: SparkSession, queries: list[str], **options: str) -> DataFrame:
    """The same as a stream that can be stopped and goes on where it was."""
    spark.dataSource.register(WorksSearch)
    return spark.readStream.format("works_search").options(queries=json.dumps(queries), **options).load()
