"""A folder of markdown notes as a Spark data source, in batch and as a stream: ``spark.read.format("notes").option("path", root)`` after ``register(spark)``.

Folders are listed where they are read: planning opens the root (or the folder that a filter on the path names) and one level of it, each folder of which is a partition that lists what is below it.
Hidden entries and node_modules are never opened, nor folders that no wanted path can be in: the globs of the options ``include`` and ``exclude`` (one a line) and, if asked, filters on ``path``
(equal, in a list, starts with) are compared with a folder before it is listed. The folder is anything that pyarrow's file systems read and all executors see."""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from ..functions.globs import literal_prefix, parse_patterns, to_regex
from ..session import ship

SCHEMA = StructType([StructField(n, TimestampType() if n.endswith("_at") else StringType()) for n in ("path", "basename", "folder", "modified_at", "created_at", "content")])
#: Notes in one Arrow batch, and bytes of them, about.
ROWS, BYTES = 500, 4 << 20


def hidden(name: str) -> bool:
    return name.startswith(".") or name == "node_modules"


@dataclass(frozen=True)
class Wanted:
    """What a reader is asked for: prefixes of which a path has one (none: any), globs, and modification times in (after, upto] in microseconds."""

    root: str
    prefixes: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    after: int | None = None
    upto: int | None = None

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.rstrip("/"))

    def folder(self, name: str) -> bool:
        """Whether anything below a folder (its path with a slash at the end) can be wanted."""
        may = lambda p: p.startswith(name) or name.startswith(p)
        heads = [literal_prefix(g) for g in self.include]
        return (not self.prefixes or any(map(may, self.prefixes))) and (not heads or any(map(may, heads)) or any(g.startswith("!") for g in self.include))

    def note(self, path: str) -> bool:
        fits = lambda globs: any(re.fullmatch(f"(?s:{to_regex(g)})", path) for g in globs)
        return path.endswith(".md") and (not self.prefixes or path.startswith(self.prefixes)) and (not self.include or fits(self.include)) and not fits(self.exclude)

    def start(self) -> str:
        """The deepest folder that all prefixes share."""
        if not self.prefixes:
            return ""
        low, high = min(self.prefixes), max(self.prefixes)
        n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        return low[: low[:n].rfind("/") + 1]


@dataclass
class Folder(InputPartition):
    """Notes of a folder, or of all below it."""

    name: str
    deep: bool


#: A partition there has to be.
NOTHING = Folder("\x00", False)


class Listing:
    """Lists folders, and counts those it opened."""

    def __init__(self, wanted: Wanted):
        self.wanted, self.opened = wanted, 0
        self.files, self.base = wanted.open()

    def entries(self, name: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Folders to go into and wanted notes, in order, of a folder."""
        self.opened += 1
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/{name}".rstrip("/"), allow_not_found=bool(name)))
        folders, notes = [], []
        for i in sorted(found, key=lambda i: i.base_name):
            if hidden(i.base_name):
                continue
            if i.type == fs.FileType.Directory and self.wanted.folder(f"{name}{i.base_name}/"):
                folders.append(f"{name}{i.base_name}/")
            elif i.type == fs.FileType.File and self.wanted.note(name + i.base_name) and self.timely(i):
                notes.append(i)
        return folders, notes

    def timely(self, i: fs.FileInfo) -> bool:
        t = i.mtime_ns // 1000 if i.mtime_ns is not None else 0
        return (self.wanted.after is None or t > self.wanted.after) and (self.wanted.upto is None or t <= self.wanted.upto)

    def partitions(self) -> list[Folder]:
        start = self.wanted.start()
        if any(map(hidden, start.split("/")[:-1])):
            return []
        folders, notes = self.entries(start)
        return [Folder(start, False)] * bool(notes) + [Folder(f, True) for f in folders]

    def notes(self, part: Folder) -> Iterator[tuple[str, fs.FileInfo]]:
        todo = [part.name]
        while todo:
            name = todo.pop()
            folders, notes = self.entries(name)
            todo += folders[::-1] if part.deep else []
            yield from ((name + i.base_name, i) for i in notes)

    def batches(self, part: Folder) -> Iterator[pa.RecordBatch]:
        schema, rows, size = to_arrow_schema(SCHEMA), [], 0
        for path, i in self.notes(part):
            with self.files.open_input_stream(i.path) as f:
                text = f.readall().decode("utf-8", "replace")
            name = path.rsplit("/", 1)[-1]
            at = dt.datetime.fromtimestamp(i.mtime_ns // 1000 / 1e6, dt.UTC) if i.mtime_ns is not None else None
            rows.append((path, name[: name.rfind(".")] if "." in name else name, path[: len(path) - len(name)].rstrip("/"), at, None, text))
            size += len(text)
            if len(rows) >= ROWS or size >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class NotesReader(DataSourceReader):
    def __init__(self, wanted: Wanted):
        self.wanted = wanted

    def partitions(self):
        return Listing(self.wanted).partitions() or [NOTHING]

    def read(self, partition: Folder):
        return Listing(self.wanted).batches(partition) if partition != NOTHING else iter(())


class FilteredReader(NotesReader):
    def pushFilters(self, filters: list[Filter]):
        """Filters on the path narrow what is listed; Spark still applies all of them."""
        for f in filters:
            found = ()
            if getattr(f, "attribute", None) == ("path",):
                found = {EqualTo: lambda f: (f.value,), In: lambda f: tuple(f.value), StringStartsWith: lambda f: (f.value,)}.get(type(f), lambda f: ())(f)
            found = tuple(v for v in found if v is not None)
            if found:
                held = self.wanted.prefixes
                both = found if not held else tuple({max(a, b, key=len) for a in held for b in found if a.startswith(b) or b.startswith(a)}) or ("\x00",)
                self.wanted = Wanted(**{**vars(self.wanted), "prefixes": both})
            yield f


class NotesStream(DataSourceStreamReader):
    """New and changed notes, each once for every change that is seen: an offset is a time, and a batch has the notes modified after one and up to the next. A note is read ``grace`` milliseconds after it was modified at the earliest, for clocks that differ."""

    def __init__(self, wanted: Wanted, grace: int):
        self.wanted, self.grace = wanted, grace

    def initialOffset(self) -> dict:
        return {"upto": -1}

    def latestOffset(self) -> dict:
        return {"upto": int(time.time() * 1e6) - self.grace * 1000}

    def partitions(self, start: dict, end: dict):
        found = Listing(Wanted(**{**vars(self.wanted), "after": start["upto"], "upto": end["upto"]})).partitions()
        return [Timed(p.name, p.deep, start["upto"], end["upto"]) for p in found]

    def read(self, partition: Timed):
        return Listing(Wanted(**{**vars(self.wanted), "after": partition.after, "upto": partition.upto})).batches(partition)


@dataclass
class Timed(Folder):
    after: int
    upto: int


class NotesSource(DataSource):
    """Options: path; include and exclude, globs, one a line; filters (true: see ``register``); grace, milliseconds."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> StructType:
        return SCHEMA

    def _wanted(self) -> Wanted:
        lines = lambda n: tuple(parse_patterns(self.options.get(n) or "", comments=False))
        if not self.options.get("path"):
            raise ValueError("the option path names the folder of notes")
        return Wanted(self.options["path"], (), lines("include"), lines("exclude"))

    def reader(self, schema: StructType) -> NotesReader:
        return (FilteredReader if self.options.get("filters") == "true" else NotesReader)(self._wanted())

    def streamReader(self, schema: StructType) -> NotesStream:
        return NotesStream(self._wanted(), int(self.options.get("grace") or 0))


def register(spark: SparkSession, filters: bool = False) -> None:
    """Make the format ``notes`` known. ``filters``: Spark may hand filters on the path down to readers with the option ``filters``, so that only folders they can be true in are listed.

    Such a reader is to be loaded anew for every query: Spark keeps what the last filtered query of a loaded DataFrame was to read, and a later query of it without such a filter would read no more."""
    ship(spark)
    if filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NotesSource)


def notes(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The notes below ``root`` that fit the globs; folders that none of them can be in are not listed."""
    ship(spark)
    spark.dataSource.register(NotesSource)
    return spark.read.format("notes").option("path", root).option("include", "\n".join(include or [])).option("exclude", "\n".join(exclude or [])).load()
