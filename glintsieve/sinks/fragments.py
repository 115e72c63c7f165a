"""Reports of any size: ordered fragments, one a task, and a manifest that makes them a report when all are written.

Registered as the format `report_parts`. Rows have one text column, in the report's order; each task writes its rows as lines of a file of its own. The
commit writes the manifest (header, separator, footer, and the fragments in order with their numbers of lines); without it there is
no report, and an abort takes the files away. Reading gives position and item of every line, a partition for each fragment;
`assembled` copies the fragments one after the other into one text.

Defined results: an empty report has a header and a footer and no line; a folder that holds a manifest is not written again; line feeds inside
an item make several lines of it; null items are left out.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from glintsieve.sinks.shared import filesystem

FORMAT = "report_parts"
MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    lines: int
    sha256: str


class FragmentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.frame = {k: options.get(k, "") for k in ("header", "separator", "footer")}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        name, lines, digest = f"part-{uuid.uuid4().hex}", 0, hashlib.sha256()
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                data = "".join(x + "\n" for x in batch.column(0).to_pylist() if x is not None).encode()
                lines += data.count(b"\n")
                digest.update(data)
                out.write(data)
        return Written(TaskContext.get().partitionId(), name, lines, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        done = sorted((m for m in messages if m), key=lambda m: m.part)
        for m in done:
            if not m.lines:
                fs.delete_file(f"{folder}/{m.file}")
        fragments = [{"file": m.file, "lines": m.lines, "sha256": m.sha256} for m in done if m.lines]
        with fs.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps({**self.frame, "fragments": fragments}).encode())
        fs.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{folder}/{m.file}")


@dataclass
class Fragment(InputPartition):
    file: str
    first: int


class FragmentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[Fragment]:
        out, first = [], 1
        for f in manifest(self.path)["fragments"]:
            out.append(Fragment(f["file"], first))
            first += f["lines"]
        return out or [Fragment("", 1)]

    def read(self, part: Fragment) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        held: list[str] = []
        at = part.first
        for line in _lines(self.path, part.file):
            held.append(line.decode())
            if len(held) == 10_000:
                yield _batch(at, held)
                at, held = at + len(held), []
        if held:
            yield _batch(at, held)


def _batch(first: int, items: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(items)), pa.int64()), pa.array(items, pa.string())], ["position", "item"])


def _lines(path: str, name: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The lines of a fragment, without their line feeds, read piece by piece."""
    fs, folder = filesystem(path)
    left = b""
    with fs.open_input_stream(f"{folder}/{name}") as data:
        while piece := data.read(size):
            *whole, left = (left + piece).split(b"\n")
            yield from whole
    if left:
        yield left


class Fragments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "position long, item string"

    def reader(self, schema) -> FragmentReader:
        return FragmentReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FragmentWriter:
        return FragmentWriter(dict(self.options))


def manifest(path: str) -> dict:
    fs, folder = filesystem(path)
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def write(items: DataFrame, item: Column, order: list[Column], path: str, header: str = "", separator: str = "", footer: str = "") -> None:
    """The items in order as a new report."""
    from pyarrow import fs as kinds

    items.sparkSession.dataSource.register(Fragments)
    fs, folder = filesystem(path)
    if fs.get_file_info(f"{folder}/{MANIFEST}").type != kinds.FileType.NotFound:
        raise FileExistsError(path)
    items.orderBy(*order).select(item.alias("item")).write.format(FORMAT).mode("append").option("path", path).option("header", header).option("separator", separator).option("footer", footer).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """position and item of every line of a report."""
    spark.dataSource.register(Fragments)
    return spark.read.format(FORMAT).load(path)


def assembled(path: str) -> Iterator[bytes]:
    """The whole report as text, piece by piece."""
    told = manifest(path)
    yield told["header"].encode()
    separator, some = told["separator"].encode(), False
    for f in told["fragments"]:
        for line in _lines(path, f["file"]):
            yield separator + line if some else line
            some = True
    yield told["footer"].encode()
