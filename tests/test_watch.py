"""Changes by manifest, the live debounce, restarts."""

import os
import shutil
import time

import pytest

from keelson.catalogue import DETECTORS
from keelson.sources.tree import ScanOptions
from keelson.streaming.changes import ChangeReader
from keelson.streaming.watch import watch

AKIA = "AKIA" + "IOSFODNN7EXAMPLE"


class Ticks:
    """The source alone: one batch after another."""

    def __init__(self, root, state, since=None):
        self.reader = ChangeReader(str(root), str(state), time.time_ns() if since is None else since, ScanOptions())
        self.at = self.reader.initialOffset()

    def batch(self, advance=True):
        end = self.reader.latestOffset()
        rows = sorted((p, k) for part in self.reader.partitions(self.at, end) for p, k, _ in self.reader.read(part))
        if advance:
            self.reader.commit(end)
            self.at = end
        return rows


@pytest.fixture()
def place(tmp_path):
    (tmp_path / "w/a/b/c/d").mkdir(parents=True)
    (tmp_path / "w/old.cs").write_text("x")
    (tmp_path / "w/a/b/c/d/deep.cs").write_text("x")
    (tmp_path / "aside").mkdir()
    return tmp_path


def test_what_a_manifest_does_not_hold_is_a_change(place):
    root, t = place / "w", None
    t = Ticks(root, place / "state")
    assert t.batch() == [] == t.batch()
    (root / "old.cs").write_text("xy")
    (root / "a/b/c/d/new.cs").write_text("n")
    assert t.batch() == [("a/b/c/d/new.cs", "created"), ("old.cs", "changed")]
    # Renamed, and moved in with an old time, alone and with its folder
    (root / "old.cs").rename(root / "renamed.cs")
    past = place / "aside/past.cs"
    past.write_text("p")
    os.utime(past, (1, 1))
    past.rename(root / "a/past.cs")
    (place / "aside/folder/in").mkdir(parents=True)
    (place / "aside/folder/in/f.cs").write_text("f")
    os.utime(place / "aside/folder/in/f.cs", (1, 1))
    time.sleep(0.05)
    t2 = t.batch()
    (place / "aside/folder").rename(root / "folder")
    assert t2 == [("a/past.cs", "created"), ("renamed.cs", "created")]
    assert t.batch() == [("folder/in/f.cs", "created")]
    (root / "renamed.cs").unlink()
    shutil.rmtree(root / "folder")
    assert t.batch() == [], "deletions are no changes"
    assert len(os.listdir(place / "state")) <= 3


def test_a_change_that_keeps_size_and_times(place):
    f = place / "w/old.cs"
    t = Ticks(place / "w", place / "state")
    f.write_text("one")
    s = f.stat()
    t.batch()
    f.write_text("two")
    os.utime(f, ns=(s.st_atime_ns, s.st_mtime_ns))
    assert t.batch() == [("old.cs", "changed")]
    # Even where the inode's own time is the same: the bytes are compared while the file is fresh
    reader = t.reader
    row = ("old.cs", 3, 5, 7, 9, 1)
    assert reader.differs(row, ("old.cs", 3, 5, 7, 9, 2)) and reader.differs(row, ("old.cs", 3, 5, 7, 9, -1)) and not reader.differs((*row[:5], -1), row)


def test_a_batch_that_is_run_again_sees_the_same(place):
    t = Ticks(place / "w", place / "state")
    t.batch()
    (place / "w/n.cs").write_text("n")
    assert t.batch(advance=False) == t.batch() == [("n.cs", "created")]


def test_since_and_scope(place):
    t = Ticks(place / "w", place / "state", since=0)
    (place / "w/image.png").write_text("x")
    (place / "w/bin").mkdir()
    (place / "w/bin/x.cs").write_text("x")
    assert t.batch() == [("a/b/c/d/deep.cs", "changed"), ("old.cs", "changed")] and t.batch() == []
    assert Ticks(place / "missing", place / "none").batch() == []


def wait(until, seconds=60):
    end = time.time() + seconds
    while not until() and time.time() < end:
        time.sleep(0.05)
    assert until()


def test_changes_close_together_are_one_flush_and_a_restart_loses_none(spark, place):
    root, flushes = place / "w", []
    start = lambda gap: watch(spark, str(root), DETECTORS, lambda df: flushes.append((time.time(), sorted(r.file for r in df.collect()))), str(place / "ck"), gap_ms=gap)
    seen = lambda: [f for _, fs in flushes for f in fs]
    q = start(300)
    try:
        wait(lambda: q.lastProgress is not None and q.lastProgress["batchId"] >= 1)
        (root / "one.cs").write_text(f'"{AKIA}"')
        time.sleep(0.2)
        (root / "two.cs").write_text(f'"{AKIA}"')
        last = time.time()
        wait(lambda: len(seen()) >= 2)
        assert [fs for _, fs in flushes] == [["one.cs", "two.cs"]] and flushes[0][0] - last >= 0.29
        (root / "one.cs").rename(root / "moved.cs")
        wait(lambda: len(seen()) >= 3)
        assert flushes[-1][1] == ["moved.cs"] and q.exception() is None
    finally:
        q.stop()
    flushes.clear()
    # A change that waits for its flush when the watch ends, and one while it is down
    q = start(600_000)
    try:
        at = (q.lastProgress or {}).get("batchId", 0)
        (root / "three.cs").write_text(f'"{AKIA}"')
        wait(lambda: q.lastProgress is not None and q.lastProgress["batchId"] >= at + 3 and any(p["numInputRows"] for p in q.recentProgress))
    finally:
        q.stop()
    assert flushes == []
    (root / "four.cs").write_text(f'"{AKIA}"')
    q = start(300)
    try:
        wait(lambda: len(seen()) >= 2)
    finally:
        q.stop()
    assert [fs for _, fs in flushes] == [["four.cs", "three.cs"]] and q.exception() is None
