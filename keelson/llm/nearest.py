"""Approximate nearest neighbours with a permutation index (operator 4).

A vector is represented by the order of its NEAREST nearest pivots, of PIVOTS. Every row is
indexed, in blocks of BLOCK rows: a block posts each row, with the pivot's place in its order,
in the inverted file of each of its nearest pivots. A query goes through the postings of its
own nearest pivots and sums the footrule distance (a pivot that a row lacks counts as place
NEAREST). In the order of footrule, ties to the smaller id, rows are ranked again by Euclidean
distance in double precision on the original vectors, step by step until patience steps in a
row leave the k best as they are: dense places, where footrules hardly differ, take longer.
The k best of a query are kept from block to block of a task, so that later blocks stop sooner
and a task sends k rows for each query. With patience None (exact) no step is left out, and the
result is that of comparing all pairs.

Pivots come from a bounded sample (the SAMPLE least hashes of vec_id; equal rows count as one). Queries are taken in
slices of QUERIES, one pass over the rows for each, whose result is written before the next
slice is read: what driver and workers hold is bounded. Recall was measured against brute force
(see tests and README).

Vectors that are null, zero, of another length than most (no distance to the others), or hold
null or non-finite components take no part, nor do rows without vec_id. Rows that repeat a
vec_id are candidates each, but for the query of that id, which is asked once, with the least of
its vectors (compared component by component). Tables without
usable vectors give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import least, stored, tune

PIVOTS, NEAREST, BLOCK, SAMPLE, QUERIES = 512, 128, 4096, 2048, 4096
#: Rows of a block are ranked again in steps of this share (and number at least), until so many steps have not changed the k best.
STEP, LEAST, PATIENCE = 0.04, 64, 4
SCHEMA = "query_id long, vec_id long, score double"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def order(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    m = min(NEAREST, len(pivots))
    d = squared(vectors, pivots)
    near = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(pivots) else np.tile(np.arange(len(pivots)), (len(d), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, in order of id."""
    lists = batch.column(1)
    fits = pc.and_(pc.equal(pc.fill_null(pc.list_value_length(lists), -1), dim), batch.column(0).is_valid())
    batch = batch.filter(fits)
    x = np.asarray(batch.column(1).flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    ids, x = np.asarray(batch.column(0))[good], x[good]
    by_id = np.argsort(ids, kind="stable")
    return ids[by_id], x[by_id]


class Block:
    """The inverted file of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        self.ids, self.vectors = ids, vectors
        o = order(vectors, pivots)
        row, place = np.divmod(np.arange(o.size), o.shape[1])
        by_pivot = np.argsort(o.ravel(), kind="stable")
        self.begin = np.searchsorted(o.ravel()[by_pivot], np.arange(len(pivots) + 1))
        self.row, self.place = row[by_pivot], place[by_pivot].astype(np.int32)

    def search(self, query_id: int, query: np.ndarray, pivots: np.ndarray, k: int, patience: int | None, so_far: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the block and of those found so far."""
        m = len(pivots)
        footrule = np.full(len(self.ids), int((m - np.arange(m)).sum()), np.int64)
        for place, pivot in enumerate(pivots.tolist()):
            own = slice(self.begin[pivot], self.begin[pivot + 1])
            footrule[self.row[own]] += np.abs(self.place[own] - place) - (m - place)
        rank = footrule * len(self.ids) + np.arange(len(self.ids))
        rank[self.ids == query_id] = np.iinfo(np.int64).max
        by_rank = np.argsort(rank, kind="stable")
        by_rank = by_rank[self.ids[by_rank] != query_id]
        step = max(LEAST, k, int(np.ceil(STEP * len(rank))))
        ids, score = so_far
        calm = 0
        for a in range(0, len(by_rank), step):
            some = by_rank[a : a + step]
            more = np.sqrt(((self.vectors[some] - query) ** 2).sum(1))
            if len(ids) == k and not (more <= score[-1]).any():
                calm += 1
                if calm == patience:
                    break
                continue
            calm = 0
            ids, score = np.concatenate([ids, self.ids[some]]), np.concatenate([score, more])
            top = np.lexsort((ids, score))[:k]
            ids, score = ids[top], score[top]
        return ids, score


def search(pivots: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, patience: int | None):
    orders = order(queries, pivots)

    def answer(parts, best) -> None:
        ids, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        by_id = np.argsort(ids, kind="stable")
        if len(ids):
            block = Block(ids[by_id], x[by_id], pivots)
            for i, (q, v, o) in enumerate(zip(query_ids.tolist(), queries, orders, strict=True)):
                best[i] = block.search(q, v, o, k, patience, best[i])

    def run(batches):
        parts, n = [], 0
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                ids, x = usable(batch.slice(a, BLOCK), pivots.shape[1])
                parts.append((ids, x))
                n += len(ids)
                if n >= BLOCK:
                    answer(parts, best)
                    parts, n = [], 0
        if parts:
            answer(parts, best)
        size = np.array([len(ids) for ids, _ in best])
        if size.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, size)), *(pa.array(np.concatenate(c)) for c in zip(*best, strict=True))], names=["query_id", "vec_id", "score"])

    return run


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", patience: int | None = PATIENCE) -> DataFrame:
    """query_id, rank from 1, vec_id and Euclidean distance of the k nearest found of every query row; patience None is exact."""
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("x"), is_query.alias("asked")).where("vec_id is not null and x is not null")
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None or length.n < 1:
        return nothing
    dim = length.n
    good = f"size(x) = {dim} and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(x, v -> v <> 0)"
    rows = rows.where(good)
    distinct = rows.select("vec_id", F.transform("x", lambda v: v.cast("double")).alias("x")).dropDuplicates()
    sample = least(distinct, F.xxhash64("vec_id"), SAMPLE, length["count"], "vec_id", "x")
    if not sample:
        return nothing
    pivots = np.unique(np.array([r.x for r in sample]), axis=0)
    pivots = pivots[np.random.default_rng(17).permutation(len(pivots))[:PIVOTS]]
    asked = rows.where("asked").select("vec_id", F.transform("x", lambda v: v.cast("double")).alias("x")).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id")
    found, ids, queries = None, [], []

    def one_pass():
        return rows.select("vec_id", "x").mapInArrow(search(pivots, np.array(ids, np.int64), np.array(queries), k, patience), SCHEMA)

    for r in asked.toLocalIterator():
        if len(ids) == QUERIES:
            more = stored(one_pass(), "nearest")
            found = more if found is None else found.unionByName(more)
            ids, queries = [], []
        ids.append(r.vec_id)
        queries.append(r.x)
    if not ids:
        return nothing
    found = one_pass() if found is None else found.unionByName(stored(one_pass(), "nearest"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
