"""Session helpers: shared folders, sizes, packed exchanges."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles; bounds a worker's memory for any batch.
PASS_BYTES = 1 << 20
#: Text bytes whose packed records are joined before they leave a worker.
FLUSH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Texts are long: fewer rows in an Arrow batch bound a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > 1024:
        spark.conf.set(key, "1024")
    # Workers look for the package where the driver found it, whatever their working directory
    there, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in there.get("PYTHONPATH", "").split(os.pathsep):
        there["PYTHONPATH"] = os.pathsep.join(filter(None, [root, there.get("PYTHONPATH", "")]))
    # Freed arrays go back to the system, so that workers that wait between tasks hold little
    there.setdefault("MALLOC_MMAP_THRESHOLD_", str(1 << 20))
    there.setdefault("MALLOC_ARENA_MAX", "2")
    there.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; one of our own only where none is named."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        sc = spark.sparkContext
        there = sc.getCheckpointDir()
        if not there:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="keelson-"))
            there = sc.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def stored(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/keelson-{name}-{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd")
    (write.partitionBy(by) if by else write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string. Without a cast there is no alias either: aliases make equal exchanges differ."""
    kinds = dict(docs.dtypes)
    as_is = lambda c, kind: F.col(c) if kinds[c] == kind else F.col(c).cast(kind).alias(c)
    return docs.select(as_is("doc_id", "bigint"), as_is("text", "string"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column: one number, from all rows."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0))).first()[0])


def least(df: DataFrame, key: Column, n: int, total: int, *ties: str) -> list[Row]:
    """The n rows of the least key, a hash of 64 bits. Of total rows only some 4 n have a key below the
    bound that is asked for first, so what partitions send to the driver doesn't grow with their number;
    where fewer than n do (copies share a key), the bound is raised."""
    share = 4 * n / max(total, 1)
    while True:
        some = df if share >= 1 else df.where(key < int(share * 2**64) - 2**63)
        rows = some.orderBy(key, *ties).limit(n).collect()
        if len(rows) == n or share >= 1:
            return rows
        share *= 16


def spread(total: int, each: int, least: int = 8, most: int = 1 << 15) -> int:
    return int(min(most, max(least, -(-total // each))))


def passes(batch_column: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    from .kernels import slices

    lengths = np.asarray(pc.fill_null(pc.binary_length(batch_column), 0), dtype=np.int64)
    return slices(lengths, most)


def pack_deltas(ids: np.ndarray) -> bytes:
    """Document ids, best in order: the first, a byte for each difference below 255, and the other differences in full."""
    d = np.diff(ids)
    small = np.where((d >= 0) & (d < 255), d, 255).astype(np.uint8)
    return ids[:1].tobytes() + small.tobytes() + d[small == 255].tobytes()


def unpack_deltas(blob: bytes, n: int) -> np.ndarray:
    d = np.empty(n, np.int64)
    d[:1] = np.frombuffer(blob, np.int64, 1)
    small = np.frombuffer(blob, np.uint8, n - 1, 8)
    d[1:] = small
    d[1:][small == 255] = np.frombuffer(blob[7 + n :], np.int64)
    return np.cumsum(d)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def run_lengths(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(begin, append=n)
