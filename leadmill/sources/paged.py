"""Captured answers of a paged API as a Python data source: ``spark.read.format("paged")`` and ``spark.readStream.format("paged")``.

A request is a folder of pages; a page is a JSON object {"places": [...], "nextPageToken": ...} in a file named by its token, the first one
``first.json``.  Requests are read by themselves, each by following its tokens, as a client of the API would.  A filter on ``request``
decides which folders are opened at all.  As a stream, requests come in the order of their names, and the offset is the last name
read; a request's folder appears whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

SCHEMA = "request string, page int, pos int, place string"
FIRST = "first"
_ROW = pa.schema([("request", pa.string()), ("page", pa.int32()), ("pos", pa.int32()), ("place", pa.string())])


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a URI (a plain path is a local one), and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass
class Requests(InputPartition):
    names: list[str]


def _names(path: str) -> list[str]:
    where, root = store_of(path)
    if where.get_file_info(root).type == fs.FileType.NotFound:
        return []
    return sorted(x.base_name for x in where.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and x.base_name[0] not in "._")


def _grouped(names: list[str], most: int) -> list[Requests]:
    return [Requests(names[i : i + most]) for i in range(0, len(names), most)]


def pages_of(where: fs.FileSystem, folder: str) -> Iterator[dict]:
    """The pages of a request, from token to token; it ends where a page names no next one, one that is missing, or one that was read."""
    token, seen = FIRST, set()
    while token and token not in seen:
        seen.add(token)
        try:
            with where.open_input_file(f"{folder}/{token}.json") as f:
                page = json.loads(f.read())
        except (FileNotFoundError, json.JSONDecodeError):
            return
        if not isinstance(page, dict):
            return
        yield page
        token = page.get("nextPageToken")


def _read(path: str, names: list[str], most_pages: int | None) -> Iterator[pa.RecordBatch]:
    where, root = store_of(path)
    for name in names:
        for n, page in enumerate(pages_of(where, f"{root}/{name}"), 1):
            if most_pages is not None and n > most_pages:
                break
            places = page.get("places")
            rows = [{"request": name, "page": n, "pos": i, "place": json.dumps(p)} for i, p in enumerate(places if isinstance(places, list) else [])]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ROW)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per_task = options["path"].rstrip("/"), int(options.get("requestspertask", 64))
        self.most_pages = int(options["mostpages"]) if "mostpages" in options else None
        self.wanted: set[str] | None = None

    def pushFilters(self, filters):
        """Equality on the request chooses the folders; what else there is, Spark filters."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("request",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self):
        names = _names(self.path)
        return _grouped([n for n in names if self.wanted is None or n in self.wanted], self.per_task) or [Requests([])]

    def read(self, partition: Requests) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition.names, self.most_pages)


class PagedStream(DataSourceStreamReader):
    """Offsets are {"after": name}: all requests up to that name have been read."""

    def __init__(self, options):
        self.path, self.per_task = options["path"].rstrip("/"), int(options.get("requestspertask", 64))
        self.most_pages = int(options["mostpages"]) if "mostpages" in options else None

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self, *_) -> dict:
        return {"after": max(_names(self.path), default="")}

    def partitions(self, start: dict, end: dict):
        return _grouped([n for n in _names(self.path) if start["after"] < n <= end["after"]], self.per_task) or [Requests([])]

    def read(self, partition: Requests) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition.names, self.most_pages)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known; filters on requests reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def capture(answers: DataFrame, path: str, per_page: int = 20) -> None:
    """Write ``answers`` (request, pos, place: JSON) as a client would have captured them: pages of so many places, chained by tokens.

    A page is gathered in one row, and written by the task that has it under a name that depends on it alone, so a task that runs again writes the
    same file.  Requests are names of folders: letters, digits, dashes and underscores.
    """
    page = F.floor(F.col("pos") / per_page).cast("int")
    last = answers.groupBy("request").agg(F.max(page).alias("_last"))
    rows = answers.groupBy("request", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", "place"))).alias("places")).join(last, "request")
    rows = rows.select("request", "page", F.transform("places", lambda p: p["place"]).alias("places"), "_last")

    def write(batches):
        where, root = store_of(path)
        for batch in batches:
            for r in batch.to_pylist():
                where.create_dir(f"{root}/{r['request']}", recursive=True)
                token = lambda n: FIRST if n == 0 else f"token{n}"
                body = {"places": [json.loads(p) for p in r["places"]]} | ({"nextPageToken": token(r["page"] + 1)} if r["page"] < r["_last"] else {})
                with where.open_output_stream(f"{root}/{r['request']}/{token(r['page'])}.json") as f:
                    f.write(json.dumps(body).encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
