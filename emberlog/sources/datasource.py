"""Failure reports as a Spark data source: spark.read.format("reports").load(path or paths).

A path is a file, a glob (** allowed), a folder with all that is in it, or a URI
of a store that pyarrow knows (file:, s3:, gs:, hdfs:). Files are listed once,
packed into partitions by size, and each is opened and decoded in a task. Hidden
files and names with brackets count. Filters on source_path are taken over where
Spark pushes them down (spark.sql.python.filterPushdown.enabled, and the option
pushdown): files that they leave out are not opened.
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from emberlog.sources.decoding import DECODED_FIELDS, DECODED_TYPE, decode

FORMAT = "reports"
#: Files and bytes that a task reads, if not a single file is larger.
FILES_OF_A_TASK, BYTES_OF_A_TASK = 256, 64 << 20
SCHEMA = f"build_key string, source_path string, folder boolean, {DECODED_FIELDS}"
FIELDS = pa.schema([("build_key", pa.string()), ("source_path", pa.string()), ("folder", pa.bool_()), *DECODED_TYPE])


@dataclass(frozen=True)
class File:
    """A file of a source: the source's place, the path as it is shown and as it is opened, the size, and the URI of its store."""

    source: int
    path: str
    at: str
    size: int
    folder: bool
    root: str = ""

    def key(self) -> str:
        return self.at if not self.root or self.root.startswith("file:") else self.path


@dataclass
class Files(InputPartition):
    files: list[File]


def build_key(source: int, path: str) -> str:
    """Order of builds: by source, then by path, part by part: / comes before any other character."""
    return f"{source:09d}|{path.replace('/', chr(1))}"


def listed(source: str, place: int) -> list[File]:
    """The files of a source; none if nothing is there."""
    if "://" in source or source.startswith("file:/"):
        return _stored(source, place)
    if os.path.isdir(source):
        found = [os.path.join(root, name) for root, _, names in os.walk(source) for name in names]
        folder = True
    else:
        found, folder = glob.glob(source, recursive=True, include_hidden=True) if glob.has_magic(source) else [source], False
    return [File(place, p, os.path.realpath(p), os.path.getsize(p), folder) for p in found if os.path.isfile(p)]


def _stored(uri: str, place: int) -> list[File]:
    """The files below a URI, listed by pyarrow; a glob lists the folder before its first part with a wildcard."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    parts = uri.split("/")
    wild = next((i for i, p in enumerate(parts) if i > 2 and glob.has_magic(p)), None)
    top = (uri if wild is None else "/".join(parts[:wild])).rstrip("/")
    store, at = fs.FileSystem.from_uri(top)
    host = top.removesuffix(at)  # what pyarrow leaves out of paths
    info = store.get_file_info(at)
    found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    if wild is not None:
        names = re.compile(glob.translate("/".join(parts[wild:]), recursive=True, include_hidden=True))
        found = [f for f in found if names.match(f.path[len(at) :].lstrip("/"))]
    folder = wild is None and info.type == fs.FileType.Directory
    return [File(place, host + f.path, f.path, f.size or 0, folder, top) for f in found if f.type == fs.FileType.File]


def _opened(file: File) -> bytes:
    if not file.root:
        with open(file.at, "rb") as f:
            return f.read()
    with fs.FileSystem.from_uri(file.root)[0].open_input_stream(file.at) as f:
        return f.read()


def _test(f: Filter) -> Callable[[str], bool] | None:
    """What a filter asks of source_path, or None if it is none that is known."""
    if getattr(f, "attribute", None) != ("source_path",):
        return None
    if isinstance(f, EqualTo):
        return lambda p: p == f.value
    if isinstance(f, In):
        values = set(f.value)
        return lambda p: p in values
    if isinstance(f, StringStartsWith):
        return lambda p: p.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda p: p.endswith(f.value)
    return None


def packed(files: list[File]) -> list[Files]:
    """Partitions of bounded number and size, in order of the files."""
    out: list[Files] = []
    count = size = 0
    for f in files:
        if not out or count == FILES_OF_A_TASK or size + f.size > BYTES_OF_A_TASK:
            out.append(Files([]))
            count = size = 0
        out[-1].files.append(f)
        count, size = count + 1, size + f.size
    return out


class ReportReader(DataSourceReader):
    def __init__(self, sources: list[str], named: bool) -> None:
        self.sources, self.named = sources, named
        self.tests: list[Callable[[str], bool]] = []

    def partitions(self) -> list[Files]:
        """The files of all sources; one that is reached twice counts once, for its first source."""
        if self.named:  # opened as they are: one that is missing is a finding
            return [Files([File(k, p, p, 0, False)]) for k, p in enumerate(self.sources)]
        first: dict[str, File] = {}
        for k, source in enumerate(self.sources):
            for f in listed(source, k):
                first.setdefault(f.key(), f)
        kept = [f for f in first.values() if all(test(f.path) for test in self.tests)]
        return packed(sorted(kept, key=lambda f: build_key(f.source, f.path))) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """A row for each report, one file at a time. In a folder, what is no report is passed over."""
        for f in partition.files:
            try:
                d = decode(_opened(f))
            except FileNotFoundError as e:
                if not self.named:
                    raise RuntimeError(f"{f.at} was listed but is not there for this task: all executors must see the same files") from e
                d = {"problem": f"Could not read report: {e}", "failures": []}
            except OSError as e:
                d = {"problem": f"Could not read report: {e}", "failures": []}
            if not (f.folder and d.get("problem")):
                row = {"build_key": build_key(f.source, f.path) if not self.named else build_key(0, f.path)[10:], "source_path": f.path, "folder": f.folder, **d}
                yield pa.RecordBatch.from_pylist([row], FIELDS)


class PushedReader(ReportReader):
    """A reader that takes filters on source_path over."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ReportReader:
        given = self.options.get("paths") or json.dumps([self.options["path"]] if "path" in self.options else [])
        kind = PushedReader if self.options.get("pushdown", "false").lower() == "true" else ReportReader
        return kind(json.loads(given), self.options.get("named", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Make format("reports") known to the session."""
    spark.dataSource.register(ReportSource)


def known_store(source: str) -> bool:
    """Whether the data source can list it: a local path, or a URI whose store pyarrow can open here."""
    if "://" not in source:
        return True
    try:
        fs.FileSystem.from_uri(source.split("*")[0].split("?")[0].split("[")[0])
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True
