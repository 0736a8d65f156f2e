"""Commit graphs: reachability by chains, membership in branches, selection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import discard, stored, workers_find_package

#: Jumps in a row are joined in one plan, so that a round leads so many times as far.
JUMPS = 2
#: Rounds whose gains stay apart before they become one table.
ROUNDS = 8


def edges(commits: DataFrame) -> DataFrame:
    return commits.select("sha", F.posexplode("parents").alias("parent_idx", "parent"))


def tips(refs: DataFrame, branch: str | None = None, tags: bool = True) -> DataFrame:
    """Commits that refs name: one branch, or all branches and, if wanted, tags."""
    branches = refs.where(F.col("kind") == "branch")
    if branch is not None:
        return branches.where(F.col("name") == branch).select("sha").distinct()
    named = branches.select("sha")
    return (named.union(refs.where(F.col("kind") == "tag").select("sha")) if tags else named).distinct()


def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes each commit of a block as far along its chain as the block reaches."""
    rows = pa.Table.from_batches(batches, WITHIN).to_pandas()
    sha, at = rows["sha"].to_numpy(), rows["at"].to_numpy()
    ends = rows["at"].isna().to_numpy()
    to = pd.Index(sha).get_indexer(at)
    stops = ends | (to < 0)
    jump = np.where(stops, np.arange(len(sha)), to)
    steps = (~stops).astype(np.int64)
    while (further := jump[jump] != jump).any():
        steps = np.where(further, steps + steps[jump], steps)
        jump = jump[jump]
    last = ends[jump]
    out = pa.Table.from_arrays([pa.array(sha, pa.string()), pa.array(at[jump], pa.string(), from_pandas=True), pa.array(np.where(last, sha[jump], None), pa.string()), pa.array(steps + ~last)], schema=JUMP)
    yield from out.to_batches(max_chunksize=65536)


#: Commits of a block, on average.
BLOCK = 1 << 20
WITHIN = pa.schema([("sha", pa.string()), ("at", pa.string())])
JUMP = pa.schema([("sha", pa.string()), ("at", pa.string()), ("chain", pa.string()), ("pos", pa.int64())])


def chains(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """(sha, chain, pos): each commit in one chain, which leads from parent to child; chain is its oldest commit, pos the distance from it.

    Of the children that have a commit as their first parent, one goes on with its chain: the
    least id. Each commit first goes as far as its block reaches; blocks go by the column near of
    nodes, if there is one: commits of about the same time are mostly each other's parents. What
    leads from block to block is followed by jumps: a round takes each commit that has not come
    to the end of its chain 2 ** JUMPS times as far, if need be until the end.
    """
    workers_find_package(edge.sparkSession)
    first = edge.where("parent is not null")
    first = first.where("parent_idx = 0") if "parent_idx" in edge.columns else first
    # One parent a commit, one child a parent
    up = first.groupBy("sha").agg(F.min("parent").alias("at")).groupBy("at").agg(F.min("sha").alias("sha"))
    seen = Observation()
    start = stored(nodes.join(up, "sha", "left").observe(seen, F.count("*").alias("n")), "up")
    blocks = -(-seen.get["n"] // BLOCK)
    if blocks > 1 and "near" in start.columns:
        dealt = start.repartitionByRange(blocks, "near")
    else:
        dealt = start.repartition(blocks, "sha") if blocks > 1 else start.coalesce(1)
    jump = dealt.select("sha", "at").mapInArrow(within, "sha string, at string, chain string, pos long")

    def further(x: DataFrame) -> DataFrame:
        y = x.select(F.col("sha").alias("key"), F.col("at").alias("next"), F.col("chain").alias("end"), F.col("pos").alias("more"))
        # Commits that have arrived match nothing, and are dealt by their own ids
        key = F.coalesce("at", F.concat(F.lit(">"), "sha"))
        return x.withColumn("key", key).join(y, "key", "left").select("sha", F.col("next").alias("at"), F.coalesce("chain", "end").alias("chain"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"))

    was = start
    while True:
        left = Observation()
        now = stored(jump.observe(left, F.count_if(F.col("chain").isNull()).alias("n")), "jump")
        discard(was)
        if not left.get["n"]:
            return now.drop("at")
        was, jump = now, now
        for _ in range(JUMPS):
            jump = further(jump)


@dataclass
class Reach:
    """What labels reach: of each chain all commits up to a position. places: (sha, chain, pos); upto: (label, chain, pos)."""

    places: DataFrame
    upto: DataFrame
    label: str

    def of(self, name: str, same: bool = True) -> Reach:
        """Of the label of this name only, or of all others."""
        wanted = F.col(self.label) == name
        return Reach(self.places, self.upto.where(wanted if same else ~wanted), self.label)

    def commits(self) -> DataFrame:
        """All (label, sha)."""
        top = self.upto.select(self.label, "chain", F.col("pos").alias("top"))
        return self.places.join(top, "chain").where("pos <= top").select(self.label, "sha")

    def shas(self) -> DataFrame:
        """Commits that any label reaches: one bound for each chain."""
        top = self.upto.groupBy("chain").agg(F.max("pos").alias("top"))
        return self.places.join(top, "chain").where("pos <= top").select("sha")

    def labels_of(self, shas: DataFrame) -> DataFrame:
        """(sha, branches) of these commits only, sorted; those that no label reaches are left out."""
        top = self.upto.select(self.label, "chain", F.col("pos").alias("top"))
        some = self.places.join(shas.select("sha").distinct(), "sha", "left_semi")
        return branches(some.join(top, "chain").where("pos <= top").select("sha", F.col(self.label).alias("branch")))


def reach(seeds: DataFrame, edge: DataFrame, label: str = "label", near: DataFrame | None = None) -> Reach:
    """What the (label, sha) rows of seeds lead to. near: (sha, near), times of commits, if known.

    A label that reaches a commit reaches its chain below it, so that all there is to keep is a
    position for each label and chain. Edges from one chain to another carry positions on; a round
    follows those that the last round's gains have opened, until nothing is gained. Rows are
    labels x chains, whatever the depth of the history.
    """
    nodes = edge.select("sha").union(edge.select("parent")).union(seeds.select("sha")).where("sha is not null").distinct()
    places = chains(nodes if near is None else nodes.join(near, "sha", "left"), edge)
    other = places.select(F.col("sha").alias("parent"), F.col("chain").alias("to"), F.col("pos").alias("to_pos"))
    cross = edge.select("sha", "parent").join(places, "sha").join(other, "parent").where("chain <> to").select("chain", F.col("pos").alias("via"), "to", "to_pos")
    ways = Observation()
    cross = stored(cross.groupBy("chain", "via", "to").agg(F.max("to_pos").alias("to_pos")).observe(ways, F.count("*").alias("n")), "cross")
    keys = [label, "chain"]
    gain = seeds.join(places, "sha").groupBy(*keys).agg(F.max("pos").alias("pos")).withColumn("was", F.lit(-1).cast("long"))
    known: list[DataFrame] = []

    def upto() -> DataFrame:
        rows = known[0]
        for k in known[1:]:
            rows = rows.union(k)
        return rows.groupBy(*keys).agg(F.max("pos").alias("pos"))

    while True:
        some = Observation()
        last = stored(gain.observe(some, F.count("*").alias("n")), "gain")
        if known and not some.get["n"]:
            return Reach(places, upto(), label)
        if not known and not ways.get["n"]:
            return Reach(places, last.select(*keys, "pos"), label)
        known.append(last.select(*keys, "pos"))
        if len(known) == ROUNDS:
            known[:] = [stored(upto(), "upto")]
        opened = last.join(cross, "chain").where("via <= pos and via > was").groupBy(label, F.col("to").alias("chain")).agg(F.max("to_pos").alias("pos"))
        before = upto().select(F.col(label).alias("l"), F.col("chain").alias("c"), F.col("pos").alias("p"))
        # Labels may be null: the tips of a scan
        gain = opened.join(before, F.col(label).eqNullSafe(F.col("l")) & (F.col("chain") == F.col("c")), "left").where("p is null or p < pos").select(*keys, "pos", F.coalesce("p", F.lit(-1).cast("long")).alias("was"))


def walk(seeds: DataFrame, edge: DataFrame, label: str) -> DataFrame | None:
    """(label, sha) that seeds lead to, by parents of parents; None where that takes more than STEPS rounds or WALKED rows.

    A round reads the edges and deals none of them out: what it goes on from is small enough for
    all tasks to have. Old or few tips of a large graph are done before chains would be.
    """
    counted = Observation()
    last = stored(seeds.select(label, "sha").where("sha is not null").distinct().observe(counted, F.count("*").alias("n")), "walk")
    known, rows = last, counted.get["n"]
    for _ in range(STEPS):
        if rows > WALKED:
            return None
        parents = edge.join(F.broadcast(last), "sha").select(label, F.col("parent").alias("sha")).where("sha is not null").distinct()
        before = F.broadcast(known.select(F.col(label).alias("l"), F.col("sha").alias("s")))
        counted = Observation()
        last = stored(parents.join(before, F.col(label).eqNullSafe(F.col("l")) & (F.col("sha") == F.col("s")), "left_anti").observe(counted, F.count("*").alias("n")), "walk")
        if not counted.get["n"]:
            return known
        known, rows = known.union(last), rows + counted.get["n"]
    return None


#: What a walk may take before chains are made instead.
STEPS, WALKED = 32, 1 << 17


def closure(seeds: DataFrame, edge: DataFrame, label: str | None = None) -> DataFrame:
    """All (label,) sha from which seeds descend, seeds included.

    A graph of one block goes by chains at once. In a larger one chains lead from block to block,
    and cost exchanges of all commits, however few are reached: there a walk is tried first.
    """
    rows = seeds.select(F.lit("").alias("label") if label is None else label, "sha")
    name = label or "label"
    if edge.count() > BLOCK:
        edge = stored(edge, "edge")
        walked = walk(rows, edge, name)
        if walked is not None:
            return walked.select("sha").distinct() if label is None else walked
    found = reach(rows, edge, name)
    return found.shas() if label is None else found.commits()


def names(refs: DataFrame, branch: str | None = None, tags: bool = True) -> DataFrame:
    """(name, sha) that all branches, and what else tips follows, begin with; null for the tips of a scan."""
    every = refs.where(F.col("kind") == "branch").select("name", "sha")
    return every.union(tips(refs, branch, tags).select(F.lit(None).cast("string").alias("name"), "sha"))


def membership(refs: DataFrame, edge: DataFrame) -> DataFrame:
    """The branches of each commit, sorted."""
    seeds = refs.where(F.col("kind") == "branch").select(F.col("name").alias("branch"), "sha")
    return branches(closure(seeds, edge, "branch"))


def branches(reach: DataFrame) -> DataFrame:
    """From (branch, sha): the branches of each commit, sorted."""
    return reach.groupBy("sha").agg(F.array_sort(F.collect_set("branch")).alias("branches"))


def unreachable(commits: DataFrame, seen: DataFrame) -> DataFrame:
    return commits.join(seen.select("sha"), "sha", "left_anti")


def since(commits: DataFrame, instant: str | None) -> DataFrame:
    """After reachability: older commits are passed through on the way, but not kept."""
    return commits if instant is None else commits.where(F.col("author_when") >= F.to_timestamp(F.lit(instant)))


def most_recent(commits: DataFrame, k: int | None) -> DataFrame:
    """The k newest, newest first; ties by sha. All of them, in no order, where k is None."""
    return commits if k is None else commits.orderBy(F.col("author_when").desc(), "sha").limit(k)


#: Commits that a scan with a time limit takes at a time, and how often at most it stops between them.
PART, PARTS = 500, 64


def by_age(commits: DataFrame, n: int) -> Iterator[tuple[DataFrame, int]]:
    """Some at a time, newest first, with their number. Cut at quantiles of age: commits of one instant stay together."""
    parts = min(PARTS, max(1, n // PART))
    age = -F.unix_micros("author_when")
    cuts = commits.select(F.percentile_approx(age, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    rows = commits.withColumn("part", reduce(lambda x, cut: x + (age > cut).cast("int"), sorted(set(cuts or [])), F.lit(0)))
    for r in rows.groupBy("part").count().orderBy("part").collect():
        yield rows.where(F.col("part") == r["part"]).drop("part"), r["count"]


def first_parents(edge: DataFrame) -> DataFrame:
    return edge.where("parent_idx = 0").select("sha", "parent")
