"""Entry points: scan a tree, scan a history, say how it went."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .catalogue import Detector, library
from .operators import baseline, findings, graph, history
from .operators.history import History
from .schemas import HISTORY_ROWS
from .sources import git
from .sources.shared import stored
from .sources.tree import ScanOptions, dealt, list_tree, open_files

T = TypeVar("T")


@dataclass
class Result:
    """Findings are stored: reports and exit codes read them, not the files again."""

    findings: DataFrame
    files_skipped: int = 0
    truncated: bool = False
    commits_walked: int | None = None

    def exit_code(self) -> int:
        return 0 if self.findings.isEmpty() else 1


class ToolError(Exception):
    """A code and an internal id, never a message with contents."""

    exit_code = 2

    def __init__(self, code: str, file_id: int | str = 0):
        super().__init__(f"scanner error {code} at internal file id {file_id}")


class OverCap(Exception):
    """A history has more commits than the caller allows."""

    def __init__(self, commits: int, cap: int):
        super().__init__(f"{commits} commits, at most {cap} allowed")
        self.commits, self.cap = commits, cap


@dataclass
class Engine:
    spark: SparkSession
    detectors: tuple[Detector, ...] | None = None
    options: ScanOptions = field(default_factory=ScanOptions)

    def library(self) -> tuple[Detector, ...]:
        chosen = self.detectors if self.detectors is not None else library(self.options.high_entropy)
        from .catalogue import severity_rank

        return tuple(d for d in chosen if severity_rank(d.severity) >= severity_rank(self.options.severity))

    def scan(self, source: str | DataFrame, known: str | None = None, seconds: float | None = None) -> Result:
        """Findings of a tree, or of a table of files (path, content; content null if it cannot be read).

        Files are read once. known: a baseline file. seconds: when they are over, files that have
        not had their turn are left out, and the result says that it is truncated; so it does if
        there are more files than max_files.
        """
        deadline = None if seconds is None else time.time() + seconds
        if isinstance(source, DataFrame):
            files, truncated = findings.limited(source.withColumn("size", F.lit(0)), self.options.max_files)
        else:
            # The limit is settled on the listing: no file beyond it is opened
            listed, truncated = findings.limited(list_tree(self.spark, source, self.options), self.options.max_files)
            files = open_files(dealt(listed, source, self.options), source, deadline)
        seen = Observation()
        files = files.observe(seen, F.count_if(F.col("content").isNull() & (F.col("size") >= 0)).alias("skipped"), F.count_if(F.col("size") < 0).alias("late"))
        found = findings.working_tree(files.where("content is not null"), self.library(), keep_keys=True)
        found = stored(findings.redacted(found, self.options.include_pii), "findings")
        # Binary or unreadable files count as skipped; what globs and size leave out does not
        counts = seen.get
        if known:
            found = baseline.suppress(found, baseline.load(self.spark, known))
        return Result(found.drop("hash16"), counts["skipped"], truncated or counts["late"] > 0)

    def scan_history(
        self,
        source: str | History,
        branch: str | None = None,
        since: str | None = None,
        max_commits: int | None = 1000,
        include_tags: bool = True,
        include_unreachable: bool = False,
        messages: bool = True,
        refuse_over_cap: bool = False,
        seconds: float | None = None,
        cancelled: Callable[[], bool] | None = None,
    ) -> Result:
        """Reachable commits of a repository, or of a history given as tables, the most recent max_commits of them; None lifts the cap.

        refuse_over_cap: a longer history raises OverCap before anything of it is read. seconds,
        cancelled: the scan goes from the newest commits back, some at a time; when the time is
        over, or cancelled() is true, what is done counts, the rest is given up, and the result says
        that it is truncated and how many commits it covers.
        """
        if max_commits is not None and max_commits <= 0:
            raise ToolError("INVALID_OPTIONS")
        stop = Stop(self.spark, seconds, cancelled)
        past = source if isinstance(source, History) else git.history(self.spark, source, self.options)
        commits = stored(past.commits.select("sha", "parents", "author_when", "author_name", "message"), "commits")
        # One index says what the tips lead to (no name) and which branches a commit is in
        seeds = graph.names(past.refs, branch, include_tags).select(F.coalesce("name", F.lit("")).alias("branch"), "sha")
        reach = graph.reach(seeds, graph.edges(commits), "branch", commits.select("sha", F.col("author_when").alias("near")))
        chosen = commits if include_unreachable else commits.join(reach.of("").shas(), "sha", "left_semi")
        chosen = stored(graph.since(chosen, since), "chosen")
        n = walked = chosen.count()
        if max_commits is not None and n > max_commits:
            if refuse_over_cap:
                raise OverCap(n, max_commits)
            chosen, walked = stored(graph.most_recent(chosen, max_commits), "chosen"), max_commits
        parts = [(chosen, walked)] if seconds is None and cancelled is None else list(graph.by_age(chosen, walked))
        found, done = [], 0
        for part, size in parts:
            rows = stop.run(lambda part=part, size=size: stored(history.file_matches(part, past.diffs(part, size), self.library()), "matches"))
            if rows is None:
                break
            found, done = [*found, (rows, part)], done + size
        first = stored(history.earliest(reduce(DataFrame.unionByName, [rows for rows, _ in found])), "earliest") if found else None
        if first is None:
            return Result(self.spark.createDataFrame([], HISTORY_ROWS), 0, True, 0)
        # What is there now is asked of all detectors, whatever the least severity
        everything = self.detectors if self.detectors is not None else library(self.options.high_entropy)
        present = findings.working_tree(past.tree, everything, keep_keys=True)
        texts = history.earliest(findings.message_findings(reduce(DataFrame.unionByName, [part for _, part in found]), self.library())) if messages else None
        rows = history.assembled(first, texts, reach.of("", False).labels_of(first.select("sha")), present)
        rows = stored(findings.redacted(rows, self.options.include_pii), "findings")
        return Result(rows, 0, walked < n or done < walked, done)


class Stop:
    """Runs jobs until there is no more time for them. A job that is under way then is interrupted, by its tag."""

    #: Seconds between two looks at the clock.
    LOOK = 0.05

    def __init__(self, spark: SparkSession, seconds: float | None, cancelled: Callable[[], bool] | None):
        self.spark, self.cancelled = spark, cancelled or (lambda: False)
        self.until = None if seconds is None else time.monotonic() + seconds
        self.always = seconds is None and cancelled is None

    def over(self) -> bool:
        return (self.until is not None and time.monotonic() > self.until) or self.cancelled()

    def run(self, job: Callable[[], T]) -> T | None:
        """What the job gives; None if it was not begun or not ended in time."""
        if self.always:
            return job()
        if self.over():
            return None
        tag, out, context = f"keelson-{uuid.uuid4().hex}", [], self.spark.sparkContext

        def tagged() -> None:
            context.addJobTag(tag)
            context.setInterruptOnCancel(True)
            try:
                out.append((job(), None))
            except Exception as e:  # noqa: BLE001
                out.append((None, e))
            finally:
                context.removeJobTag(tag)

        worker = InheritableThread(target=tagged)
        worker.start()
        late = False
        while worker.is_alive():
            worker.join(self.LOOK)
            if self.over() and worker.is_alive():
                # Again and again: a job may be between two stages when the first call comes
                late = True
                context.cancelJobsWithTag(tag)
        result, error = out[0]
        if error is not None and not late:
            raise error
        return result
