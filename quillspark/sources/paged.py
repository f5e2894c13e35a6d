"""Large texts by pages: ``spark.read.format("quill_pages").load(path)`` plans a file as ranges of bytes, each read by a task of its own.

Pages end with a form feed. A range owns the pages that begin in it: it looks for its first one, and reads on past its end until its
last is whole. So every page is read once, whatever the ranges, and a task holds one page at a time. Paths are any that Arrow's file
systems know; a path without a scheme is one that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What ends a page, bytes of a range, bytes that are read at a time, and pages that are handed on together.
END, RANGE_BYTES, READ_BYTES, TOGETHER = b"\x0c", 32 << 20, 1 << 20, 256
KIND = "path string, range int, place int, start long, text string"


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def decoded(page: bytes) -> str:
    """UTF-8 where it is valid, else Latin-1, in which all bytes are."""
    try:
        return page.decode()
    except UnicodeDecodeError:
        return page.decode("latin-1")


@dataclass
class Range(InputPartition):
    path: str
    number: int
    start: int
    end: int

    def __post_init__(self):
        super().__init__(self.number)


def pages_of(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, page) of the pages that begin at ``start`` or after it and before ``end``. A page begins at 0 and after each
    END, one at the end of the file included."""
    at = start  # where the page at hand begins
    if start:
        file.seek(start - 1)
        while (block := file.read(READ_BYTES)) and (found := block.find(END)) < 0:
            at += len(block)
        if not block:
            return
        at += found
        file.seek(at)
    held: list[bytes] = []
    while at < end:
        block = file.read(READ_BYTES)
        if not block:
            yield at, b"".join(held)
            return
        *whole, rest = block.split(END)
        for part in whole:
            if at >= end:
                return
            page = b"".join((*held, part))
            yield at, page
            at, held = at + len(page) + 1, []
        held.append(rest)


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        system, root = system_of(self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            # A last page that is empty begins where the file ends.
            cuts = range(0, f.size + 1, self.range_bytes)
            out += [Range(f.path, i, at, at + self.range_bytes) for i, at in enumerate(cuts)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = system_of(self.path)
        held: list[tuple] = []
        kind = pa.schema([("path", pa.string()), ("range", pa.int32()), ("place", pa.int32()), ("start", pa.int64()), ("text", pa.string())])

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in held], schema=kind)

        with system.open_input_file(partition.path) as file:
            for place, (start, page) in enumerate(pages_of(file, partition.start, partition.end)):
                held.append((partition.path, partition.number, place, start, decoded(page)))
                if len(held) == TOGETHER:
                    yield closed()
                    held = []
        yield closed()


class PagedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_pages"

    def schema(self) -> str:
        return KIND

    def reader(self, schema) -> DataSourceReader:
        size = int(self.options.get("rangeBytes", RANGE_BYTES))
        if size < 1:
            raise ValueError("a range has a byte at least")
        return _Reader(self.options["path"], size)


def read_pages(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, page_number (from 1), text of every page of the files at or below ``path``. A page's number is its place in its range and
    the pages of the ranges before, of which each is one row."""
    spark.dataSource.register(PagedText)
    pages = spark.read.format("quill_pages").option("rangeBytes", range_bytes).load(path)
    counts = pages.groupBy("path", "range").agg((F.max("place") + 1).alias("n"))
    before = counts.select("path", "range", (F.sum("n").over(Window.partitionBy("path").orderBy("range")) - F.col("n")).alias("before"))
    return pages.join(before, ["path", "range"]).select("path", (F.col("before") + F.col("place") + 1).cast("int").alias("page_number"), "text")
