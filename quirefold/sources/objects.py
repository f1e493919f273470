"""Object stores as tables: keys are listed in tasks, batch or stream, and objects written from tasks.

The driver only looks at the first level below the root. Each prefix found there is one
partition, walked folder by folder where it is read, so a listing of any length is never
held in one place and there is no file index. A stream hands out the objects whose time of
change lies between two moments: a trigger lists in its tasks what is new since the last
one, and what it has handed out is remembered as one moment, not as a list of files.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "objects"
LISTED = "key string, mtime timestamp, size bigint"
#: Rows of one Arrow batch of a listing.
ROWS = 10_000
#: A store may show an object this long after the time of change it gives it.
SETTLE_MS = 1000


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a root and the root within it; ``file:/x`` and plain paths are local."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    store, base = (fs.LocalFileSystem(), root) if root.startswith("/") else fs.FileSystem.from_uri(root)
    return store, base.rstrip("/")


class _Prefix(InputPartition):
    """One prefix below the root; the root itself gives only the objects directly in it."""

    def __init__(self, prefix: str, deep: bool, after: int | None = None, until: int | None = None) -> None:
        self.prefix, self.deep, self.after, self.until = prefix, deep, after, until


def _prefixes(root: str, after: int | None = None, until: int | None = None) -> list[_Prefix]:
    store, base = _open(root)
    first = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return [_Prefix("", False, after, until)] + [_Prefix(i.base_name, True, after, until) for i in first if i.type == fs.FileType.Directory]


def _listed(root: str, part: _Prefix) -> Iterator[pa.RecordBatch]:
    store, base = _open(root)
    folders, keys, times, sizes = [f"{base}/{part.prefix}" if part.prefix else base], [], [], []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.timestamp("us", "UTC")), pa.array(sizes, pa.int64())], ["key", "mtime", "size"])
        for held in (keys, times, sizes):
            held.clear()
        return made

    while folders:
        for info in store.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True)):
            if info.type == fs.FileType.Directory:
                if part.deep:
                    folders.append(info.path)
                continue
            changed = info.mtime_ns // 1_000_000 if info.mtime_ns is not None else 0
            if (part.after is None or changed > part.after) and (part.until is None or changed <= part.until):
                keys.append(info.path[len(base) + 1 :])
                times.append(info.mtime)
                sizes.append(info.size)
        if len(keys) >= ROWS:
            yield batch()
    if keys:
        yield batch()


class _Listing(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[_Prefix]:
        return _prefixes(self.root)

    def read(self, partition: _Prefix) -> Iterator[pa.RecordBatch]:
        return _listed(self.root, partition)


class _NewObjects(DataSourceStreamReader):
    """Offsets are moments in milliseconds: objects that changed after one and not after the other."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": int(time.time() * 1000) - SETTLE_MS}

    def partitions(self, start: dict, end: dict) -> list[_Prefix]:
        return _prefixes(self.root, start["until"], end["until"])

    def read(self, partition: _Prefix) -> Iterator[pa.RecordBatch]:
        return _listed(self.root, partition)


class _ObjectWriter(DataSourceWriter):
    """One object per row of ``key, content``; an object appears whole, a second attempt replaces it with the same."""

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, base = _open(self.root)
        made = set()
        for row in iterator:
            target = f"{base}/{row.key}"
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            draft = f"{folder}/.{row.key.rsplit('/', 1)[1] if '/' in row.key else row.key}.{time.time_ns()}"
            with store.open_output_stream(draft) as out:
                out.write(bytes(row.content))
            store.move(draft, target)
        return WriterCommitMessage()


class Objects(DataSource):
    """``format("objects").load(root)``: key, mtime and size of every object; writing takes ``key, content``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Listing(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _NewObjects(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ObjectWriter(self.options["path"])


def object_listing(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """(key, mtime, size) of every object below ``root``; contents are never read."""
    spark.dataSource.register(Objects)
    return (spark.readStream if stream else spark.read).format(FORMAT).load(root)


def write_objects(objects: DataFrame, root: str) -> None:
    """Rows of ``key, content`` as objects below ``root``; keys are relative and of at least one name."""
    objects.sparkSession.dataSource.register(Objects)
    objects.select("key", "content").write.format(FORMAT).mode("append").save(root)
