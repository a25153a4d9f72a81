"""Folders of notes as a data source: spark.read.format("notes") and spark.readStream.format("notes").

Register it with register(spark). Options: path, the folder; suffix (.md); state, for streams: a folder on
shared storage for listings. Columns: path, stem, page, text, mtime, length, and state (batch: new).

Reading. Files are packed into partitions of up to PACK bytes. A schema without text reads no file at all,
and conditions on stem, page, path and mtime are applied to the listing, so only the files that they leave
are opened. A file that vanishes between listing and reading has no row.

Streaming. An offset is the number of a listing (path, mtime, length), kept in the state folder until the
batch that ends with it is committed. A batch is what differs between two listings: new and modified files
with their text, deleted ones without. So, unlike with Spark's own file stream, files that are rewritten or
deleted are seen. A batch that is run again has the same files; a file that was rewritten in between has
its newer text, and comes again with the next listing.

Files are listed and read with Arrow's file systems, on the machines that run the source.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

#: Bytes of files that one partition reads.
PACK = 8 << 20
SCHEMA = "path string, stem string, page string, text string, mtime timestamp, length long, state string"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri if "://" in uri else posixpath.abspath(uri))


@dataclass(frozen=True)
class File:
    path: str
    mtime: float
    length: int
    state: str = "new"

    def row(self, suffix: str) -> dict:
        stem = posixpath.basename(self.path).removesuffix(suffix)
        when = None if self.state == "deleted" else datetime.fromtimestamp(self.mtime, timezone.utc)
        return {"path": self.path, "stem": stem, "page": stem.replace("___", "/"), "text": None, "mtime": when, "length": self.length, "state": self.state}


@dataclass
class Pack(InputPartition):
    files: list[File]

    def __post_init__(self) -> None:
        super().__init__(self.files)


def listed(folder: str, suffix: str) -> list[File]:
    """The files of a folder, by path; none without the folder."""
    system, path = place(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((File(f.path, f.mtime_ns / 1e9, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)), key=lambda f: f.path)


def packed(files: Iterable[File]) -> list[Pack]:
    out, size = [], 0
    for f in files:
        if not out or size + f.length > PACK:
            out.append(Pack([]))
            size = 0
        out[-1].files.append(f)
        size += f.length
    return out


def rows(pack: Pack, columns: list[str], folder: str, suffix: str) -> Iterator[tuple]:
    """The columns asked for; files are opened only for their text."""
    system, _ = place(folder)
    for f in pack.files:
        row = f.row(suffix)
        if "text" in columns and f.state != "deleted":
            try:
                with system.open_input_stream(f.path) as stream:
                    row["text"] = stream.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
            except FileNotFoundError:
                continue
        yield tuple(row[c] for c in columns)


#: What a condition on the listing is tested by.
TESTS = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    StringStartsWith: lambda a, b: a.startswith(b),
}


class FolderReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.folder, self.suffix, self.columns = options["path"], options.get("suffix", ".md"), columns
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the conditions that the listing can tell; Spark keeps the others."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in ("path", "stem", "page", "mtime", "length"):
                self.filters.append(f)
            else:
                yield f

    def _fits(self, file: File) -> bool:
        row = file.row(self.suffix)
        for f in self.filters:
            own, value = row[f.attribute[0]], f.value
            if isinstance(value, datetime) and value.tzinfo is None:
                own = own.replace(tzinfo=None)
            if not TESTS[type(f)](own, value):
                return False
        return True

    def partitions(self) -> list[Pack]:
        return packed(f for f in listed(self.folder, self.suffix) if self._fits(f)) or [Pack([])]

    def read(self, partition: Pack) -> Iterator[tuple]:
        return rows(partition, self.columns, self.folder, self.suffix)


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        if "state" not in options:
            raise ValueError("a stream of notes needs the option state, a folder on shared storage")
        self.folder, self.suffix, self.columns = options["path"], options.get("suffix", ".md"), columns
        self.system, self.state = place(options["state"])
        self.system.create_dir(self.state, recursive=True)

    def _numbers(self) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(self.state))
        return sorted(int(posixpath.basename(f.path)) for f in found if posixpath.basename(f.path).isdigit())

    def _listing(self, number: int) -> dict[str, File]:
        if not number:
            return {}
        with self.system.open_input_stream(f"{self.state}/{number}") as f:
            return {p: File(p, m, n) for p, m, n in json.loads(f.read())}

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        last = max(self._numbers(), default=0)
        now = {f.path: f for f in listed(self.folder, self.suffix)}
        if now == self._listing(last):
            return {"listing": last}
        aside = f"{self.state}/{last + 1}.part"
        with self.system.open_output_stream(aside) as f:
            f.write(json.dumps([[f_.path, f_.mtime, f_.length] for f_ in now.values()]).encode())
        self.system.move(aside, f"{self.state}/{last + 1}")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        before, now = self._listing(start["listing"]), self._listing(end["listing"])
        came = [File(p, f.mtime, f.length, "modified" if p in before else "new") for p, f in now.items() if before.get(p) != f]
        gone = [File(p, f.mtime, 0, "deleted") for p, f in before.items() if p not in now]
        return packed([*came, *gone])

    def read(self, partition: Pack) -> Iterator[tuple]:
        return rows(partition, self.columns, self.folder, self.suffix)

    def commit(self, end: dict) -> None:
        """Listings before the end of a committed batch are needed no more."""
        for n in self._numbers():
            if n < end["listing"]:
                self.system.delete_file(f"{self.state}/{n}")

    def stop(self) -> None:
        pass


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options, schema.names)

    def streamReader(self, schema: StructType) -> FolderStream:
        return FolderStream(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Notes)
