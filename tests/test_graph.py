"""Reachability by chains against plain walks."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keelson.operators import graph


def walk(parents, seeds):
    """(label, commit) by following parents."""
    out = set()
    for label, tip in seeds:
        todo = [tip]
        while todo:
            c = todo.pop()
            if (label, c) not in out:
                out.add((label, c))
                todo += parents.get(c, ())
    return out


def table(spark, parents):
    rows = [(c, i, p) for c, ps in parents.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "sha string, parent_idx int, parent string")


def histories():
    rng = random.Random(1)
    line = {str(i): [str(i - 1)] for i in range(1, 40)}
    wild = {f"{i:03d}": [f"{p:03d}" for p in rng.sample(range(max(0, i - 6), i), min(i, rng.choice([1, 1, 1, 2, 3])))] for i in range(1, 150)}
    # A main line and a branch every third commit, merged five later; the branch hangs on the main line
    merged = {f"m{i:02d}": [f"m{i - 1:02d}"] + ([f"b{i - 5:02d}"] if i % 3 == 2 and i > 5 else []) for i in range(1, 60)} | {f"b{i:02d}": [f"m{i:02d}"] for i in range(0, 57, 3)}
    # Two lines that merge into each other all the time: a label changes chains at each commit
    ladder = {f"x{i}": [f"y{i - 1}", f"x{i - 1}"] for i in range(1, 20)} | {f"y{i}": [f"x{i - 1}", f"y{i - 1}"] for i in range(1, 20)}
    roots = {"a1": ["a0"], "b1": ["b0"], "c": ["a1", "b1", "gone"]}
    return [line, wild, merged, ladder, roots]


@pytest.mark.parametrize("k, block", [*((k, 1 << 20) for k in range(5)), (1, 7), (2, 7), (0, 5)])
def test_reach_is_what_a_walk_finds(spark, k, block, monkeypatch):
    """Within one block, and from block to block by jumps."""
    monkeypatch.setattr(graph, "BLOCK", block)
    parents = histories()[k]
    rng = random.Random(k)
    commits = sorted(parents)
    seeds = [(f"l{j % 4}", rng.choice(commits)) for j in range(6)] + [("lone", "nowhere else"), ("l0", commits[-1])]
    edge, tips = table(spark, parents), spark.createDataFrame(seeds, "label string, sha string")
    want = walk(parents, seeds)
    near = edge.select("sha", F.xxhash64("sha").alias("near")).distinct() if k == 2 else None
    found = graph.reach(tips, edge, near=near)
    assert {tuple(r) for r in found.commits().collect()} == want
    assert sorted(r.sha for r in found.shas().collect()) == sorted({c for _, c in want})
    some = commits[::3]
    labels = defaultdict(list)
    for label, c in sorted(want):
        labels[c].append(label)
    got = {r.sha: r.branches for r in found.labels_of(spark.createDataFrame([(c,) for c in some], "sha string")).collect()}
    assert got == {c: labels[c] for c in some if labels[c]}
    assert {r.sha for r in found.of("l0").shas().collect()} == {c for x, c in want if x == "l0"}


def test_chains_cover_each_commit_once(spark):
    for parents in histories():
        edge = table(spark, parents)
        nodes = sorted({*parents, *(p for ps in parents.values() for p in ps)})
        rows = {r.sha: (r.chain, r.pos) for r in graph.chains(spark.createDataFrame([(c,) for c in nodes], "sha string"), edge).collect()}
        assert sorted(rows) == nodes and len(set(rows.values())) == len(nodes)
        at = {place: c for c, place in rows.items()}
        assert all(parents[c][0] == at[chain, pos - 1] for c, (chain, pos) in rows.items() if pos)


def test_a_chain_of_a_thousand_commits_is_quick(spark):
    edge = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 1000)], "sha string, parent string").cache()
    tip = spark.createDataFrame([("999",)], "sha string")
    assert graph.closure(tip, edge).count() == 1000
    took = []
    for _ in range(3):
        began = time.time()
        assert graph.closure(tip, edge).count() == 1000
        took.append(time.time() - began)
    assert min(took) < 4, took  # about 1.5 s on an idle machine


def test_five_hundred_branches_keep_rows_for_chains_only(spark):
    """500 branches of a main line of 5000 commits: labels x chains, not labels x commits."""
    main = spark.range(1, 5000).select(F.format_string("m%05d", "id").alias("sha"), F.lit(0).alias("parent_idx"), F.format_string("m%05d", F.col("id") - 1).alias("parent"))
    twigs = spark.range(500).select(F.format_string("z%03d", "id").alias("sha"), F.lit(0).alias("parent_idx"), F.format_string("m%05d", F.col("id") * 10).alias("parent"))
    found = graph.reach(twigs.select(F.col("sha").alias("label"), "sha"), main.union(twigs))
    assert found.upto.count() <= 2 * 500
    two = spark.createDataFrame([("m04985",), ("m00000",)], "sha string")
    assert {(r.sha, len(r.branches)) for r in found.labels_of(two).collect()} == {("m04985", 1), ("m00000", 500)}


@pytest.mark.parametrize("k, steps, walked", [(2, 99, 1 << 17), (4, 99, 1 << 17), (0, 3, 1 << 17), (1, 99, 20)])
def test_closure_of_large_graphs_is_what_a_walk_finds(spark, k, steps, walked, monkeypatch):
    """By a walk, and by chains where a walk is too long or too wide."""
    monkeypatch.setattr(graph, "BLOCK", 7)
    monkeypatch.setattr(graph, "STEPS", steps)
    monkeypatch.setattr(graph, "WALKED", walked)
    parents = histories()[k]
    commits = sorted(parents)
    seeds = [("l0", commits[-1]), ("l1", commits[len(commits) // 2]), ("l1", commits[0]), ("lone", "nowhere else"), ("l0", None)]
    want = walk(parents, [s for s in seeds if s[1]])
    edge, tips = table(spark, parents), spark.createDataFrame(seeds, "label string, sha string")
    assert sorted(tuple(r) for r in graph.closure(tips, edge, "label").collect()) == sorted(want)
    assert sorted(r.sha for r in graph.closure(tips, edge).collect()) == sorted({c for _, c in want})


def test_few_commits_of_a_large_graph_need_no_chains(spark, monkeypatch):
    """Chains deal out all commits; a tip near the root reaches few of them."""
    monkeypatch.setattr(graph, "BLOCK", 100)
    monkeypatch.setattr(graph, "chains", lambda *_: pytest.fail("chains of the whole graph"))
    edge = spark.range(1, 5000).select(F.col("id").cast("string").alias("sha"), F.lit(0).alias("parent_idx"), F.floor((F.col("id") - 1) / 2).cast("string").alias("parent"))
    tip = spark.createDataFrame([("100",)], "sha string")
    assert sorted(int(r.sha) for r in graph.closure(tip, edge).collect()) == [0, 2, 5, 11, 24, 49, 100]
