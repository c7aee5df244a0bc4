"""Readers by format name: `quarry_events`, an event log in Parquet files as a batch or as a stream that resumes after an event
id, and `quarry_feed`, the members of product feeds.

    eventsource.register(spark)
    spark.read.format("quarry_events").option("path", folder).option("after", 120).load()
    spark.readStream.format("quarry_events").option("path", folder).option("cursor", file).load()

An offset is the last event id taken. Files are added to the folder, and ids rise with them; what a trigger takes is cut
into row groups, each its own partition, and row groups without an id in range are not read. With `cursor`, committed
offsets are kept in a small file too, so that a reader without a checkpoint goes on where the last one was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
MEMBERS = "file string, url string, title string, vendor string, price string, images array<string>, available boolean"


def _files(path: str, ending: str) -> tuple[pafs.FileSystem, list[str]]:
    """Files below a folder in order of name, or one file; any store that Arrow can open."""
    fs, at = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return fs, [at]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    names = (f.path for f in found if f.type == pafs.FileType.File)
    return fs, sorted(n for n in names if n.endswith(ending) and not n.rpartition("/")[2].startswith(("_", ".")))


@dataclass
class Span(InputPartition):
    """A row group and the ids wanted of it: above `after`, up to `until`."""

    file: str
    group: int
    after: int
    until: int | None


class _Groups:
    """The row groups of a folder with their least and highest ids; a file's footer is read once."""

    def __init__(self, path: str, key: str):
        self.path, self.key, self.known = path, key, {}

    def all(self) -> list[tuple[str, int, int, int]]:
        fs, names = _files(self.path, ".parquet")
        for name in names:
            if name not in self.known:
                with fs.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
                at, groups = meta.schema.names.index(self.key), []
                for g in range(meta.num_row_groups):
                    stats = meta.row_group(g).column(at).statistics
                    if stats is not None and stats.has_min_max:
                        groups.append((name, g, stats.min, stats.max))
                self.known[name] = groups
        return [g for name in names for g in self.known[name]]

    def highest(self) -> int:
        return max((g[3] for g in self.all()), default=-1)

    def spans(self, after: int, until: int | None) -> list[Span]:
        return [Span(name, g, after, until) for name, g, low, high in self.all() if high > after and (until is None or low <= until)]


def _rows(span: Span | None, path: str, key: str, schema: StructType) -> Iterator[pa.RecordBatch]:
    """The wanted rows of a row group; Spark reads one partition that is None where there are none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if span is None:
        return
    target = to_arrow_schema(schema)
    fs, _ = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(span.file) as f:
        table = pq.ParquetFile(f).read_row_group(span.group, columns=target.names)
    ids = table[key]
    wanted = pc.greater(ids, span.after)
    if span.until is not None:
        wanted = pc.and_(wanted, pc.less_equal(ids, span.until))
    table = table.filter(wanted)
    columns = [pc.assume_timezone(c, "UTC") if pa.types.is_timestamp(t.type) and c.type.tz is None else c for c, t in zip(table.columns, target, strict=True)]
    yield from pa.table([c.cast(t.type) for c, t in zip(columns, target, strict=True)], schema=target).to_batches(max_chunksize=10_000)


class EventReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.key = schema, options["path"], options.get("key", "event_id")
        self.after = int(options.get("after", -1))
        self.until = int(options["until"]) if "until" in options else None

    def partitions(self) -> list[Span]:
        return _Groups(self.path, self.key).spans(self.after, self.until)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition, self.path, self.key, self.schema)


class EventStreamReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.key = schema, options["path"], options.get("key", "event_id")
        self.first, self.cursor = int(options.get("after", -1)), options.get("cursor")
        self.until = int(options["until"]) if "until" in options else None
        self.groups = _Groups(self.path, self.key)

    def initialOffset(self) -> dict:
        return {"after": max(self.first, read_cursor(self.cursor))}

    def latestOffset(self) -> dict:
        highest = self.groups.highest()
        return {"after": max(self.initialOffset()["after"], highest if self.until is None else min(highest, self.until))}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.groups.spans(start["after"], end["after"]) if end["after"] > start["after"] else []

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition, self.path, self.key, self.schema)

    def commit(self, end: dict) -> None:
        if self.cursor and end["after"] > read_cursor(self.cursor):
            fs, at = pafs.FileSystem.from_uri(self.cursor)
            with fs.open_output_stream(f"{at}.new") as f:
                f.write(json.dumps(end).encode())
            fs.move(f"{at}.new", at)


def read_cursor(path: str | None) -> int:
    """The last event id that was committed to a cursor, -1 if there is none."""
    if not path:
        return -1
    fs, at = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type == pafs.FileType.NotFound:
        return -1
    with fs.open_input_stream(at) as f:
        return int(json.loads(f.read())["after"])


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_events"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema: StructType) -> EventReader:
        return EventReader(schema, self.options)

    def streamReader(self, schema: StructType) -> EventStreamReader:
        return EventStreamReader(schema, self.options)


@dataclass
class Feeds(InputPartition):
    files: list[str]


class FeedReader(DataSourceReader):
    """JSON feeds, a file each; a file that is no feed gives nothing."""

    def __init__(self, options: dict[str, str]):
        self.path, self.origin, self.each = options["path"], options["origin"].rstrip("/"), int(options.get("filesPerPartition", 64))

    def partitions(self) -> list[Feeds]:
        names = _files(self.path, ".json")[1]
        return [Feeds(names[k : k + self.each]) for k in range(0, len(names), self.each)]

    def read(self, partition: Feeds | None) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for name in partition.files if partition else ():
            with fs.open_input_stream(name) as f:
                try:
                    body = json.loads(f.read())
                except ValueError:
                    continue
            products = body.get("products") if isinstance(body, dict) else None
            for p in products if isinstance(products, list) else []:
                if not isinstance(p, dict) or not p.get("handle"):
                    continue
                first = next((v for v in p.get("variants") or [] if isinstance(v, dict)), {})
                price = first.get("price")
                images = [i["src"] for i in p.get("images") or [] if isinstance(i, dict) and i.get("src")]
                yield name.rpartition("/")[2], f"{self.origin}/products/{p['handle']}", p.get("title"), p.get("vendor"), None if price is None else str(price), images, bool(first.get("available"))


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_feed"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> FeedReader:  # noqa: ARG002
        return FeedReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (EventSource, FeedSource):
        spark.dataSource.register(source)
