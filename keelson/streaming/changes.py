"""File changes as a stream: folders are listed by tasks and compared with what the last batch saw.

An offset is an instant that names a manifest: a file for each folder of files (path, size, change
times, inode), written by the task that lists it. A batch lists again, and what the manifest of its
start does not hold is a change: files that are made, written to, renamed or moved in, whatever
their own times say. Deletions are no changes. A batch that is run again compares with the same
manifest. The tree and the folder of manifests have to be where the executors are.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import zlib
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.shared import workers_find_package
from ..sources.tree import ScanOptions, contents, folders, walk

#: A file whose time is so near the listing's may change again without its times: its bytes are compared, too.
NEAR_NS = 100_000_000
KEYS = ["path", "size", "mtime", "ctime", "inode", "crc"]
SCHEMA = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in KEYS[1:])])


class Folder(InputPartition):
    """A folder of files, with or without the folders in it, between two manifests; each name ends in what the other begins with."""

    def __init__(self, path: str, deep: bool, start: int, end: int):
        self.path, self.deep, self.start, self.end = path, deep, start, end


class ChangeReader(DataSourceStreamReader):
    def __init__(self, root: str, state: str, since: int, options: ScanOptions):
        self.root, self.state, self.since, self.options = os.path.abspath(root), state, since, options

    def initialOffset(self):
        return {"ns": 0}

    def latestOffset(self):
        return {"ns": time.time_ns()}

    def partitions(self, start, end):
        return [Folder(path, deep, start["ns"], end["ns"]) for path, deep in folders(self.root, self.options)]

    def manifest(self, tick: int, part: Folder) -> str:
        return os.path.join(self.state, str(tick), f"{zlib.crc32(part.path.encode()):08x}-{part.path.replace(os.sep, '+')[-80:]}.parquet")

    def listed(self, part: Folder) -> list[tuple]:
        rows, now = [], time.time_ns()
        for full, path, _ in walk(self.root, self.options, part.path, part.deep):
            try:
                s = os.stat(full)
                crc = checksum(full) if max(s.st_mtime_ns, s.st_ctime_ns) > now - NEAR_NS else -1
            except OSError:
                continue
            rows.append((path, s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_ino, crc))
        return rows

    def read(self, partition):
        seen = time.time_ns()
        now = self.listed(partition)
        before = None
        if partition.start:
            there = self.manifest(partition.start, partition)
            before = {r["path"]: tuple(r.values()) for r in pq.read_table(there).to_pylist()} if os.path.exists(there) else {}
        kept = self.manifest(partition.end, partition)
        os.makedirs(os.path.dirname(kept), exist_ok=True)
        part = f"{kept}.{os.getpid()}.{time.time_ns()}"
        pq.write_table(pa.table([pa.array(c, t.type) for c, t in zip(zip(*now, strict=True), SCHEMA, strict=True)], schema=SCHEMA) if now else SCHEMA.empty_table(), part)
        os.replace(part, kept)
        for row in now:
            path, _, mtime, ctime, _, _ = row
            if before is None:
                if mtime > self.since:
                    yield path, "changed", mtime / 1e9
            elif path not in before:
                # What is moved in with its folder has old times: it came at some time up to now
                yield path, "created", (ctime if ctime > partition.start else seen) / 1e9
            elif self.differs(before[path], row):
                yield path, "changed", max(mtime, ctime) / 1e9

    def differs(self, was: tuple, row: tuple) -> bool:
        if was[1:5] != row[1:5]:
            return True
        if was[5] == -1:
            return False
        try:
            return was[5] != (row[5] if row[5] != -1 else checksum(os.path.join(self.root, row[0])))
        except OSError:
            return False

    def commit(self, end):
        """Manifests before this one go, but for the last of them: a batch may be run again."""
        try:
            older = sorted(int(x) for x in os.listdir(self.state) if x.isdigit() and int(x) < end["ns"])
        except OSError:
            return
        for tick in older[:-1]:
            shutil.rmtree(os.path.join(self.state, str(tick)), ignore_errors=True)


def checksum(full: str) -> int:
    with open(full, "rb") as f:
        return zlib.crc32(f.read())


class ChangeSource(DataSource):
    @classmethod
    def name(cls):
        return "keelson_changes"

    def schema(self):
        return "path string, kind string, at double"

    def streamReader(self, schema):
        chosen = json.loads(self.options.get("scan", "{}"))
        chosen = ScanOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in chosen.items()})
        return ChangeReader(self.options["path"], self.options["state"], int(self.options.get("since", time.time_ns())), chosen)


def changes(spark: SparkSession, root: str, state: str, since_ns: int | None = None, options: ScanOptions | None = None) -> DataFrame:
    """(path, kind, at). state: the folder of manifests. The first batch gives what was written after since_ns (by default, after now)."""
    workers_find_package(spark)
    spark.dataSource.register(ChangeSource)
    stream = spark.readStream.format("keelson_changes").option("scan", json.dumps(asdict(options or ScanOptions())))
    return stream.option("state", re.sub("^file:(//)?(?=/)", "", state)).option("since", str(time.time_ns() if since_ns is None else since_ns)).load(root)


def opened(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of the paths that can still be read and are text, read by tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([contents(os.path.join(root, path))], pa.string())], names=["path", "content"])

    return paths.select("path").mapInArrow(run, "path string, content string").where("content is not null")
