"""Histories that are stopped or given as tables, commits from packs, requests."""

import json
import os
import subprocess
import threading
import time

import pytest

from keelson.catalogue import DETECTORS
from keelson.engine import Engine, Stop
from keelson.operators import findings, graph
from keelson.operators.history import History
from keelson.service import Limits, Service
from keelson.sources import git
from keelson.sources.tree import ScanOptions, list_tree, open_files

AKIA = "AKIA" + "IOSFODNN7EXAMPLE"


def call(folder, *args, text=None):
    return subprocess.run(["git", "-C", str(folder), "-c", "user.name=T", "-c", "user.email=t@t", *args], check=True, capture_output=True, input=text).stdout.decode()


def imported(folder, n, first=0):
    """n commits of one file each, a minute apart; every tenth adds a key."""
    folder.mkdir(exist_ok=True)
    if not (folder / ".git").exists():
        call(folder, "init", "-q", "-b", "main")
    stream = []
    for i in range(first, first + n):
        text = f'key = "AKIA{i:016d}"\n' if i % 10 == 0 else f"line {i}\n"
        at = f"A <a@a> {1700000000 + 60 * i} +0000"
        stream.append(f"commit refs/heads/main\nmark :{i + 1}\nauthor {at}\ncommitter {at}\ndata 10\nmessage é\n" + (f"from {'refs/heads/main^0' if i == first else f':{i}'}\n" if i else "") + f"M 100644 inline f{i}.cs\ndata {len(text)}\n{text}\n")
    call(folder, "-c", "fastimport.unpackLimit=1", "fast-import", "--quiet", text="".join(stream).encode())
    call(folder, "checkout", "-qf", "main")
    return str(folder)


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    folder = tmp_path_factory.mktemp("limits") / "r"
    imported(folder, 30)
    repo = imported(folder, 30, 30)
    for name in ("loose", "dangling"):
        (folder / "b.env").write_text(f"Password=real-one-{name}\n")
        call(folder, "add", "-A")
        call(folder, "commit", "-qm", f"{name}\n\nwith a body\x1e and \x1f marks")
    call(folder, "reset", "-q", "--hard", "HEAD~1")
    call(folder, "tag", "-a", "v1", "-m", "a tag is no commit")
    return repo


def test_commits_are_those_of_the_log(spark, repository):
    wanted = call(repository, "log", "--all", "--format=%H %P").split("\n")[:-1]
    dangling = call(repository, "rev-parse", "HEAD@{1}").strip()
    rows = git.commits(spark, repository).collect()
    assert len(rows) == len({r.sha for r in rows}) == 62
    assert {" ".join([r.sha, *r.parents]) for r in rows if r.sha != dangling} == {x.strip() for x in wanted}
    loose = next(r for r in rows if r.message.startswith("loose"))
    assert loose.message == "loose\n\nwith a body\x1e and \x1f marks" and loose.author_name == "T"
    parts = git.CommitReader(repository, 4).partitions()
    assert sum(p.pack is not None for p in parts) == 2 and sum(p.pack is None for p in parts) == 1


def test_packs_are_cut_into_ranges(repository, monkeypatch):
    reader = git.CommitReader(repository, 4)
    whole = sorted(x for p in reader.partitions() for x in reader.ids(p))
    monkeypatch.setattr(git, "OBJECTS", 7)
    cut = reader.partitions()
    assert len(cut) > 20 and sorted(x for p in cut for x in reader.ids(p)) == whole


def test_borrowed_objects(spark, repository, tmp_path):
    subprocess.run(["git", "clone", "-q", "--shared", repository, str(tmp_path / "c")], check=True)
    assert git.commits(spark, str(tmp_path / "c")).count() == 62


def test_history_work_goes_to_all_cores(spark, repository):
    commits = graph.most_recent(git.commits(spark, repository), 1000)
    diffs = git.file_diffs(repository, commits, 61)
    assert diffs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert git.file_diffs(repository, commits, 5000).rdd.getNumPartitions() == 25


def test_a_scan_in_parts_finds_the_same(spark, repository, monkeypatch):
    monkeypatch.setattr(graph, "PART", 10)
    key = lambda r: sorted((f.commit_sha, f.file, f.line, f.hint, f.still_present) for f in r.findings.collect())
    whole, parts = Engine(spark).scan_history(repository), Engine(spark).scan_history(repository, seconds=600)
    assert key(whole) == key(parts) and len(key(whole)) == 7
    assert (parts.commits_walked, parts.truncated) == (whole.commits_walked, whole.truncated) == (61, False)


def test_a_scan_that_is_stopped_says_what_it_did(spark, repository, monkeypatch):
    monkeypatch.setattr(graph, "PART", 10)
    none = Engine(spark).scan_history(repository, seconds=0)
    assert (none.truncated, none.commits_walked, none.findings.count(), none.exit_code()) == (True, 0, 0, 0)
    rounds = []
    original = git.file_diffs

    def counted(repo, shas, n=None):
        rounds.append(n)
        return original(repo, shas, n)

    monkeypatch.setattr(git, "file_diffs", counted)
    some = Engine(spark).scan_history(repository, cancelled=lambda: len(rounds) >= 3)
    # The third part may have ended just before it was to be interrupted
    assert some.truncated and some.commits_walked in (sum(rounds[:2]), sum(rounds)) and some.commits_walked < 61
    newest = {f"f{i}.cs" for i in range(61 - some.commits_walked, 60)} | {"b.env"}
    assert {r.file for r in some.findings.collect()} <= newest and some.findings.count() >= 1


def test_a_job_under_way_is_interrupted(spark):
    from pyspark.sql import functions as F

    @F.udf("int")
    def slow(x):
        time.sleep(30)
        return x

    began = time.time()
    assert Stop(spark, 1.5, None).run(lambda: spark.range(4).select(slow("id")).collect()) is None
    assert time.time() - began < 20
    assert Stop(spark, 60, None).run(lambda: spark.range(4).count()) == 4
    with pytest.raises(ZeroDivisionError):
        Stop(spark, 60, None).run(lambda: 1 // 0)
    flag = threading.Event()
    flag.set()
    assert Stop(spark, None, flag.is_set).run(lambda: 1) is None


def test_a_history_of_tables(spark):
    from datetime import datetime

    commits = spark.createDataFrame([("a", [], datetime(2024, 1, 1), "A", "start"), ("b", ["a"], datetime(2024, 1, 2), None, f"say {AKIA}"), ("lost", [], datetime(2024, 1, 3), "A", "x")], "sha string, parents array<string>, author_when timestamp, author_name string, message string")
    refs = spark.createDataFrame([("main", "branch", "b")], "name string, kind string, sha string")
    tree = spark.createDataFrame([("now.env", "Password=still-there-1;")], "path string, content string")
    diffs = spark.createDataFrame(
        [("a", "x.env", "added", "@@ -0,0 +1,2 @@\n+Password=still-there-1;\n+k", "Password=still-there-1;\nk\n"), ("b", "y.cs", "added", f'@@ -0,0 +1 @@\n+var k = "{AKIA}";', f'var k = "{AKIA}";\n'), ("lost", "z.cs", "added", '@@ -0,0 +1 @@\n+x = "AKIA' + "Z" * 16 + '"', 'x = "AKIA' + "Z" * 16 + '"')],
        "sha string, path string, status string, patch string, content string",
    )
    past = History.of_tables(commits, refs, tree, diffs)
    rows = {(r.source, r.secret_type): r for r in Engine(spark, DETECTORS).scan_history(past).findings.collect()}
    assert set(rows) == {("history", "ConnectionString"), ("history", "AwsAccessKey"), ("commitMessage", "AwsAccessKey")}
    assert rows["history", "ConnectionString"].still_present and not rows["history", "AwsAccessKey"].still_present
    assert rows["history", "AwsAccessKey"].branches == ["main"]
    assert Engine(spark, DETECTORS).scan_history(past, include_unreachable=True).findings.count() == 4


def test_requests_are_checked_and_answered(spark, repository, tmp_path):
    place = os.path.dirname(repository)
    service = Service(spark, place)
    body = json.loads(service.scan_history(repository))
    assert body["commitsWalked"] == 61 and not body["truncated"] and len(body["findings"]) == 7 and "error" not in body
    assert all("entropy" not in f and "authorName" not in f for f in body["findings"])
    assert json.loads(Service(spark, place, limits=Limits(seconds=0)).scan_history(repository))["truncatedReason"]
    tree = json.loads(service.scan_tree(repository, ["**/*.cs"], "critical"))
    assert len(tree["findings"]) == 6 and tree["filesSkipped"] == 0 and not tree["truncated"]
    few = json.loads(Service(spark, place, limits=Limits(files=1)).scan_tree(repository))
    assert few["truncated"]
    for answer, word in (
        (service.scan_tree("/etc"), "system"),
        (service.scan_tree(str(tmp_path.parent.parent / "elsewhere")), "workspace"),
        (service.scan_tree(repository, severity="loud"), "severity"),
        (service.scan_history(repository, max_commits=0), "commits"),
        (service.scan_history(repository, since="soon"), "date"),
        (service.scan_history(place), "repository"),
    ):
        body = json.loads(answer)
        assert word in body["error"] and body["findings"] == [], answer


def test_the_limit_of_files_is_settled_on_the_listing(spark, tmp_path):
    for i in range(3000):
        folder = tmp_path / f"t/d{i % 30:02d}/e/f"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i:04d}.cs").write_text(f'"{AKIA}"')
    root = str(tmp_path / "t")
    listed = list_tree(spark, root)
    assert listed.count() == 3000 and listed.columns == ["path", "size"]
    files, more = findings.limited(listed, 10)
    opened = open_files(files, root).collect()
    assert more and sorted(r.path for r in opened) == [f"d00/e/f/{i:04d}.cs" for i in range(0, 300, 30)]
    plan = files._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
    result = Engine(spark, options=ScanOptions(max_files=10)).scan(root)
    assert result.truncated and result.findings.count() == 10
    assert not Engine(spark, options=ScanOptions(max_files=3000)).scan(root).truncated
    one = Engine(spark).scan(f"{root}/d00/e/f/0000.cs").findings.collect()
    assert [r.file for r in one] == ["0000.cs"]
