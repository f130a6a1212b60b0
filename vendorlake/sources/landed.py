"""``landed_files``: the files under a landing prefix as a Spark data source.

Spark's own sources leave out empty files and names that begin with ``_`` or
``.``; a vendor's drop may be either, and has to be accounted for.  This source
lists every file, at any depth, but for the markers that Spark itself writes.

*Batch*: each folder below the prefix is listed by the task that reads it, so no
file path passes through the driver.  The drop's name prunes folders before they
are listed; its age and size prune the listing.  These are options, not pushed
filters: Spark 4.1 keeps what was pushed into a Python source for later uses of
the same frame, which then lacks rows.

*Stream*: an offset names an entry of a log in the checkpoint's folder.  An entry
holds the files first seen by one listing, in parquet; a micro-batch reads the
entries between its offsets, so a replayed batch sees the same files again.

Columns: ``path`` as Spark spells it, ``length``, ``modified_at``, and
``file_name``, the drop: a file at the top, a folder, or the value of a
``key=value`` folder.
"""
from __future__ import annotations

import datetime as dt
import hashlib
import re
import sys
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

#: Names that Spark itself leaves in a folder it wrote.
SPARK_MARKERS = ("_SUCCESS", "_temporary", "_metadata", "_common_metadata", "_spark_metadata")
SCHEMA = "path string, length long, modified_at timestamp, file_name string"
_ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")),
                    ("file_name", pa.string())])
_FOLDERS, _FILES = 16, 10_000            # folders listed by a batch task, files read by a stream task


def open_root(root: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, the prefix as Spark spells it)."""
    if root.startswith("file:") or root.startswith("/"):
        path = "/" + root.removeprefix("file:").strip("/")
        return fs.LocalFileSystem(), path, "file:" + path
    filesystem, path = fs.FileSystem.from_uri(quote(root.rstrip("/"), safe="/:@"))
    return filesystem, path, root.rstrip("/")


def _ours(relative: str) -> bool:
    """Whether this is a landed file, not something Spark left."""
    names = relative.split("/")
    return not names[-1].endswith(".crc") and not any(n in SPARK_MARKERS for n in names)


def drop_name(relative: str) -> str:
    first, _, rest = relative.partition("/")
    return re.sub("^[^=]+=", "", first) if rest else first


def _files(filesystem: fs.FileSystem, base: str, folder: str, recursive: bool) -> Iterator[tuple[str, int, dt.datetime]]:
    """(path below ``base``, length, modified) of the files in ``folder``."""
    for info in filesystem.get_file_info(fs.FileSelector(folder, recursive=recursive, allow_not_found=True)):
        relative = info.path[len(base):].lstrip("/")
        if info.is_file and _ours(relative):
            modified = dt.datetime.fromtimestamp((info.mtime_ns or 0) // 10**6 / 1000, dt.timezone.utc)
            yield relative, info.size, modified


def _batch(prefix: str, files: list[tuple[str, int, dt.datetime]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f"{prefix}/{f[0]}" for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()),
         pa.array([f[2] for f in files], pa.timestamp("us", "UTC")), pa.array([drop_name(f[0]) for f in files], pa.string())],
        schema=_ARROW)


def _moment(text: str) -> dt.datetime:
    """A time in an option; one without a zone is UTC."""
    value = dt.datetime.fromisoformat(text)
    return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)


class Partition(ds.InputPartition):
    def __init__(self, folders: Sequence[str], recursive: bool, entry: int = 0, start: int = 0):
        super().__init__(None)
        self.folders, self.recursive, self.entry, self.start = tuple(folders), recursive, entry, start


class Listing(ds.DataSourceReader):
    """The batch reader."""

    def __init__(self, options):
        self.root, self.pattern = options["path"], options.get("pattern")
        self.after, self.before = (_moment(options[x]) if options.get(x) else None for x in ("modifiedafter", "modifiedbefore"))
        self.least = int(options.get("minlength") or 0)

    def _named(self, drop: str) -> bool:
        return not self.pattern or re.search(self.pattern, drop) is not None

    def _wanted(self, file: tuple[str, int, dt.datetime]) -> bool:
        relative, length, modified = file
        return (length >= self.least and (self.after is None or modified >= self.after)
                and (self.before is None or modified < self.before) and self._named(drop_name(relative)))

    def partitions(self):
        filesystem, base, prefix = open_root(self.root)
        info = filesystem.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such folder: {self.root}")
        if info.is_file:
            return [Partition([base], False)]
        folders = sorted(i.path for i in filesystem.get_file_info(fs.FileSelector(base)) if not i.is_file
                         and _ours(i.base_name) and self._named(drop_name(f"{i.base_name}/-")))
        return [Partition([base], False), *(Partition(folders[i:i + _FOLDERS], True) for i in range(0, len(folders), _FOLDERS))]

    def read(self, partition):
        filesystem, base, prefix = open_root(self.root)
        if filesystem.get_file_info(base).is_file:
            base, _, name = base.rpartition("/")
            prefix = prefix.rpartition("/")[0]
            found: Iterator = (f for f in _files(filesystem, base, base, False) if f[0] == name)
        else:
            found = (f for folder in partition.folders for f in _files(filesystem, base, folder, partition.recursive))
        held: list = []
        for f in found:
            if self._wanted(f):
                held.append(f)
            if len(held) == _FILES:
                yield _batch(prefix, held)
                held = []
        yield _batch(prefix, held)


class Arrivals(ds.DataSourceStreamReader):
    """The stream reader.  Offsets are {"entry": number of the last log entry}."""

    def __init__(self, options):
        self.root, self.log = options["path"], options["log"]
        self.pattern = options.get("pattern")
        self.last = 0
        self.seen: set[bytes] | None = None

    def _entry(self, number: int) -> tuple[fs.FileSystem, str]:
        filesystem, base, _ = open_root(self.log)
        return filesystem, f"{base}/{number:012d}.parquet"

    def _load(self) -> None:
        """What the log holds already: a driver that starts again goes on from there."""
        self.seen = set()
        filesystem, base, _ = open_root(self.log)
        filesystem.create_dir(base, recursive=True)
        for info in sorted(filesystem.get_file_info(fs.FileSelector(base)), key=lambda i: i.path):
            if re.fullmatch(r"\d{12}\.parquet", info.base_name):
                self.last = int(info.base_name[:12])
                self.seen |= {_digest(p) for p in pq.read_table(info.path, columns=["path"], filesystem=filesystem)["path"].to_pylist()}

    def initialOffset(self):
        return {"entry": 0}

    def latestOffset(self):
        if self.seen is None:
            self._load()
        filesystem, base, prefix = open_root(self.root)
        new = [f for f in _files(filesystem, base, base, True) if _digest(f"{prefix}/{f[0]}") not in self.seen
               and (not self.pattern or re.search(self.pattern, drop_name(f[0])))]
        if new:
            table = pa.Table.from_batches([_batch(prefix, sorted(new))])
            filesystem, path = self._entry(self.last + 1)
            written = f"{path}.{uuid.uuid4().hex}"
            pq.write_table(table, written, filesystem=filesystem)
            filesystem.move(written, path)               # an entry is there whole or not at all
            self.last += 1
            self.seen |= {_digest(p) for p in table["path"].to_pylist()}
        return {"entry": self.last}

    def partitions(self, start, end):
        out = []
        for number in range(start["entry"] + 1, end["entry"] + 1):
            filesystem, path = self._entry(number)
            rows = pq.read_metadata(path, filesystem=filesystem).num_rows
            out += [Partition((), False, number, i) for i in range(0, rows, _FILES)]
        return out

    def read(self, partition):
        filesystem, path = self._entry(partition.entry)
        yield from pq.read_table(path, filesystem=filesystem).slice(partition.start, _FILES).cast(_ARROW).to_batches()


def _digest(path: str) -> bytes:
    return hashlib.blake2b(path.encode(), digest_size=16).digest()


class LandedFiles(ds.DataSource):
    """Options: ``path``; ``pattern``, a regular expression for the drop's name;
    ``modifiedAfter`` (inclusive) / ``modifiedBefore``; ``minLength``; ``log`` for
    streams."""

    @classmethod
    def name(cls):
        return "landed_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Listing(self.options)

    def streamReader(self, schema):
        return Arrivals(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session."""
    if not getattr(spark, "_landed_files", False):
        # by value: the process that plans a stream has no shipped packages
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        try:
            spark.dataSource.register(LandedFiles)
        finally:
            cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
        spark._landed_files = True


def landed_files(spark: SparkSession, root: str, **options: str | None) -> DataFrame:
    register(spark)
    reader = spark.read.format("landed_files")
    return reader.options(**{k: v for k, v in options.items() if v is not None}).load(root)


def landed_stream(spark: SparkSession, root: str, log: str, **options: str | None) -> DataFrame:
    register(spark)
    reader = spark.readStream.format("landed_files").option("log", log)
    return reader.options(**{k: v for k, v in options.items() if v is not None}).load(root)
