"""Line diffs against git, changes and renames between snapshots."""

import random
import subprocess
from datetime import datetime

from pyspark.sql import functions as F

from keelson.catalogue import DETECTORS
from keelson.engine import Engine
from keelson.functions import linediff
from keelson.operators import diff, history, snapshots

AKIA = "AKIA" + "IOSFODNN7EXAMPLE"


def length_of_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_the_shortest_edit():
    rng = random.Random(1)
    for n in range(600):
        a = [rng.randrange(rng.choice([2, 4, 20])) for _ in range(rng.randint(0, 25))]
        b = [rng.randrange(rng.choice([2, 4, 20])) for _ in range(rng.randint(0, 25))] if n % 3 else [x for x in a if rng.random() < 0.8] + [1]
        gone, new = linediff.changed(a, b)
        assert [x for x, g in zip(a, gone, strict=True) if not g] == [x for x, g in zip(b, new, strict=True) if not g]
        assert sum(not g for g in gone) == length_of_common(a, b)


def edited(rng, text):
    out = []
    for x in text.split("\n"):
        if rng.random() < 0.15:
            continue
        out.append(x if rng.random() > 0.1 else x + " changed")
        if rng.random() < 0.1:
            out += [f"new {rng.random()}" for _ in range(rng.randint(1, 3))]
    return "\n".join(out) + rng.choice(["", "\n"])


def test_added_lines_are_those_of_git(tmp_path):
    rng = random.Random(3)
    for k in range(25):
        before = "\n".join(f"line {i} of {k}" for i in range(rng.randint(0, 60))) + rng.choice(["", "\n"])
        after = edited(rng, before) if k else ""
        (tmp_path / "a").write_text(before)
        (tmp_path / "b").write_text(after)
        git = subprocess.run(["git", "diff", "--no-index", "--no-color", "a", "b"], cwd=tmp_path, capture_output=True, text=True).stdout
        assert diff.enumerate_added(linediff.patch(before, after)) == diff.enumerate_added(git), (before, after)


def test_changes_and_renames(spark):
    body = "".join(f"line {i} of the body\n" for i in range(30))
    common = "licence text that all files hold\n" * 3
    first = {"keep": "same", "edit": "one\ntwo\n", "gone": "bye\n", "old": common + body, "far": common + "far away\n" * 5, "bin": None}
    second = {"keep": "same", "edit": "one\ntwo and a half\nthree\n", "new": common + body + "added\n", "near": common + "something else\n" * 12, "bin": None, "more": None}
    files = spark.createDataFrame([(s, p, t) for s, tree in (("a", first), ("b", second), ("c", {})) for p, t in tree.items()], "sha string, path string, content string")
    commits = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["b"])], "sha string, parents array<string>")
    rows = {(r.sha, r.path): r for r in snapshots.file_changes(commits, files).collect()}
    assert {k[1]: r.status for k, r in rows.items() if k[0] == "b"} == {"edit": "modified", "gone": "deleted", "new": "renamed", "far": "deleted", "near": "added", "more": "added"}
    assert {r.status for k, r in rows.items() if k[0] == "a"} == {"added"} and {r.status for k, r in rows.items() if k[0] == "c"} == {"deleted"}
    assert diff.enumerate_added(rows["b", "new"].patch) == [(34, "added")] and diff.enumerate_added(rows["b", "edit"].patch) == [(2, "two and a half"), (3, "three")]
    assert rows["a", "bin"].patch == "" and rows["b", "near"].patch.count("\n+") == 15


def test_the_most_alike_is_the_rename(spark):
    body = [f"line {i}\n" for i in range(40)]
    came = spark.createDataFrame([("s", "x", "".join(body)), ("s", "y", "".join(body[:30])), ("s", "z", "".join(body))], "sha string, path string, content string")
    went = spark.createDataFrame([("s", "p", "".join(body)), ("s", "q", "".join(body[:30])), ("t", "r", "".join(body))], "sha string, path string, content string")
    assert sorted(tuple(r) for r in snapshots.renames(came, went).collect()) == [("s", "x", "p"), ("s", "y", "q")]
    assert snapshots.renames(came.limit(0), went).collect() == []


def test_a_history_of_snapshots(spark):
    commits = spark.createDataFrame([("a", [], datetime(2024, 1, 1), "A", "start"), ("b", ["a"], datetime(2024, 1, 2), "A", "x")], "sha string, parents array<string>, author_when timestamp, author_name string, message string")
    refs = spark.createDataFrame([("main", "branch", "b")], "name string, kind string, sha string")
    files = spark.createDataFrame([("a", "x.env", f"k\nkey={AKIA}\n"), ("b", "x.env", f"k\nkey={AKIA}\nPassword=real-one-here\n"), ("b", "y.env", f"key={AKIA}\n")], "sha string, path string, content string")
    found = Engine(spark, DETECTORS).scan_history(snapshots.history(commits, refs, files, "b")).findings.collect()
    assert {(r.secret_type, r.commit_sha, r.file, r.line, r.still_present) for r in found} == {("AwsAccessKey", "a", "x.env", 2, True), ("ConnectionString", "b", "x.env", 3, True)}


def test_exchanges_of_matches_carry_no_facts(spark):
    """What a detector says of all its matches is put in after them, and a commit goes with its order once."""
    commits = spark.createDataFrame([("c1", "2024-01-02", "A"), ("c2", "2024-01-01", "B")], "sha string, author_when string, author_name string").withColumn("author_when", F.to_timestamp("author_when"))
    text = "AKIA" + "Q" * 16
    diffs = spark.createDataFrame([(c, f"{c}.env", "added", f"@@ -0,0 +1 @@\n+{text}\n", text + "\n") for c in ("c1", "c2")], "sha string, path string, status string, patch string, content string")
    found = history.earliest(history.file_matches(commits, diffs, DETECTORS), DETECTORS)
    assert [(r.sha, r.file, r.author_name, r.detector_id, r.secret_type, r.severity, r.line, r.offset) for r in found.collect()] == [("c2", "c2.env", "B", "aws.access_key_id", "AwsAccessKey", "critical", 1, 0)]
    assert "suggested_fix" in found.columns and found.first()["suggested_fix"] == DETECTORS[2].suggested_fix and len(found.first()["hash16"]) == 32
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "suggested_fix" not in plan.split("SortMergeJoin")[-1].split("Generate")[0] and "unhex" in plan
