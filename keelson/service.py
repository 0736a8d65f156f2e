"""Requests of agents: checked, scanned within limits, answered as one JSON text.

A request that is refused is answered with an error that names the request, never contents. What
the limits leave out makes the answer truncated. The transport is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TypeVar

from pyspark.sql import SparkSession

from . import report, requests
from .engine import Engine, Result
from .sources import git
from .sources.tree import ScanOptions


T = TypeVar("T")


class Refused(Exception):
    """What a request asks for is not there."""


@dataclass(frozen=True)
class Limits:
    """Of one request: files of a tree, seconds of either scan."""

    files: int = requests.MOST_FILES
    seconds: float = requests.MOST_SECONDS


@dataclass
class Service:
    spark: SparkSession
    workspace: str
    allow_outside: bool = False
    limits: Limits = Limits()

    def scan_tree(self, path: str = "./", include: list[str] | None = None, severity: str = "medium") -> str:
        """Findings of a folder or file of the workspace."""
        options = lambda: ScanOptions(requests.severity(severity), tuple(include or ("**/*",)), max_files=self.limits.files)
        scan = lambda full, o: Engine(self.spark, options=o).scan(full, seconds=self.limits.seconds)
        return self._answer(path, options, scan, lambda r: {"filesSkipped": r.files_skipped})

    def scan_history(self, path: str = "./", branch: str | None = None, since: str | None = None, max_commits: int = 1000, severity: str = "medium", cancelled: Callable[[], bool] | None = None) -> str:
        """Findings of the commits of a repository of the workspace, the most recent max_commits of them."""
        checked = lambda: (requests.severity(severity), requests.instant(since), requests.commits(max_commits))

        def scan(full: str, chosen: tuple) -> Result:
            least, start, most = chosen
            if git.toplevel(full) is None:
                raise Refused("there is no repository at this path")
            return Engine(self.spark, options=ScanOptions(least)).scan_history(full, (branch or "").strip() or None, start, most, seconds=self.limits.seconds, cancelled=cancelled)

        return self._answer(path, checked, scan, lambda r: {"commitsWalked": r.commits_walked})

    def _answer(self, path: str, check: Callable[[], T], scan: Callable[[str, T], Result], facts: Callable[[Result], dict[str, Any]]) -> str:
        try:
            chosen = check()
        except ValueError as e:
            return report.to_wire(None, error=str(e))
        place = requests.boundary(path, self.workspace, self.allow_outside)
        if not place.allowed:
            return report.to_wire(None, error=place.reason)
        try:
            result = scan(place.path, chosen)
        except Refused as e:
            return report.to_wire(None, error=str(e))
        return report.to_wire(result.findings, result.truncated, **facts(result))
