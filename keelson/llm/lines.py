"""Line deduplication over levelled sorted runs of line hashes (operator 11). DataFrame operations only.

A line's key is the line without white space (`[\\x20\\x09-\\x0D]`) at both ends, A-Z lower-cased.
Keys of at least least_chars code points that stand in at least least_docs documents lose all
their lines, except in the document of the largest id that holds them.

Runs are tables of (a, b, top, n): 128 bits of hash, the largest id and the number of documents,
one row a key, bucketed and sorted by hash, so that a join with a run moves none of its rows.
Each batch of documents becomes entries; entries that a run has settled already (least_docs
reached, an id at least as large) change nothing and are taken out by a merge anti-join with each
run; the others are the batch's own run at level 0. When a level has fanout runs, they are merged
into one of the next, so that a row moves once a level. Batches may come in any order, but a document belongs to one of them; the
query takes a corpus as eight batches from the largest ids down, where a key settles soonest.
A key that all documents hold is one entry a batch: documents are counted before they meet in a
bucket. What each row loses comes from one join of lines and settled keys, whose large partitions
Spark splits, and goes back to the texts by id and hash of the text.

Documents are told by doc_id: rows that repeat one are one document, and each keeps or loses
lines of its own text. Rows without doc_id are no document: nothing is counted or lost there.
Null and empty texts are one empty line; a text whose lines all go becomes the empty text. Texts
of any length are taken whole (a document's lines are one row's array). An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, spread, stored

LEAST_CHARS, LEAST_DOCS, BATCHES, FANOUT = 40, 5, 8, 4
#: Keys of a bucket, at most on average: some 128 MB of a run.
BUCKET = 1 << 22
WHITE = " \t\n\x0b\x0c\r"
KEY = ["a", "b"]


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(WHITE))
    # Lower-casing all letters would join more than A-Z; without others it is the faster way
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a mark of the text, by which rows of one id are told apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("mark", F.xxhash64("text"))


def keyed(rows: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, mark, pos, a, b) of each line that is long enough."""
    lines = rows.where("doc_id is not null").select("doc_id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.length("line") >= least_chars).select("doc_id", "mark", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return lines.select("doc_id", "mark", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def entries(lines: DataFrame) -> DataFrame:
    """(a, b, top, n) of a batch. Counted in two steps: what all documents hold is summed up where they are read."""
    return lines.select("doc_id", *KEY).distinct().groupBy(*KEY).agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))


class Runs:
    """The index: levels of sorted runs in the shared folder."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fanout: int = FANOUT, buckets: int = 8):
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = buckets
        self.levels: list[list[tuple[str, str]]] = []

    def runs(self) -> list[DataFrame]:
        """Largest first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name, _ in level]

    def add(self, batch: DataFrame) -> None:
        """The entries of a batch that the runs do not settle become a run."""
        for run in self.runs():
            settled = run.where(F.col("n") >= self.least_docs).select(*KEY, F.col("top").alias("settled"))
            batch = batch.join(settled.hint("merge"), [batch.a == settled.a, batch.b == settled.b, settled.settled >= batch.top], "left_anti")
        self._put(batch, 0)

    def merged(self) -> DataFrame:
        return self._merge(self.runs())

    def settled(self) -> DataFrame:
        """(a, b, top) of all keys that least_docs documents hold."""
        return self.merged().where(F.col("n") >= self.least_docs).select(*KEY, "top")

    def drop(self) -> None:
        while self.levels:
            self._drop(self.levels.pop())

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        # By a struct: Spark 4.1 takes a union of bucketed tables for bucketed and drops the exchange that
        # the same columns ask for, though their files are read in other groups. Structs hash like columns
        rows = reduce(DataFrame.unionByName, runs).groupBy(F.struct(*KEY).alias("key"))
        return rows.agg(F.max("top").alias("top"), F.sum("n").alias("n")).select("key.*", "top", "n")

    def _put(self, rows: DataFrame, level: int) -> None:
        name = f"keelson_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}"
        rows.write.option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) == self.fanout:
            full = self.levels[level]
            self._put(self._merge([self.spark.table(n) for n, _ in full]), level + 1)
            self.levels[level] = self.levels[level][len(full) :]
            self._drop(full)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def remove_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, text (what stays), n_lines (before), n_dropped; a row for each row of docs."""
    spark, rows = docs.sparkSession, rows_of(docs)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = reduce(lambda x, cut: x + (F.col("doc_id") <= cut).cast("int"), sorted(set(cuts)), F.lit(0))
    lines = stored(keyed(rows, least_chars).withColumn("batch", batch), "lines", by="batch")
    sizes = {r.batch: r["count"] for r in lines.groupBy("batch").count().collect()}  # a number for each batch
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spread(sum(sizes.values()), BUCKET))
    index = Runs(spark, least_docs, fanout, buckets)
    for b in sorted(sizes):
        index.add(entries(lines.where(F.col("batch") == b)))
    out = rows.withColumn("gone", F.lit(None).cast("array<int>"))
    if sizes:
        settled = stored(index.settled(), "settled")
        index.drop()
        lost = lines.join(settled.hint("merge"), KEY).where("doc_id <> top").groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("gone"))
        out = rows.join(lost, ["doc_id", "mark"], "left")
    # The lines are bound once: named in the inner function, they would be split anew for each of them
    stay = lambda all_lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone")), lambda i: F.get(all_lines, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.element_at(F.transform(F.array(F.split("text", "\n", -1)), stay), 1))
    feeds = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return out.select("doc_id", text.alias("text"), (feeds + 1).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
