"""The command: `python -m keelson [options]` scans a tree, `python -m keelson history [options]` a repository.

Exit codes: 0 without findings, 1 with findings, 2 if the command could not do its work. What
goes wrong is named by its kind only. Hooks are not installed (see README).
"""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from . import report, requests
from .engine import Engine, OverCap
from .operators import baseline, history
from .sources import config, git
from .sources.shared import remove, shared_dir
from .sources.tree import ScanOptions

Out = Callable[[str], None]


class Wrong(Exception):
    """What the caller asked for cannot be done."""


class Parser(argparse.ArgumentParser):
    def error(self, message):
        raise Wrong(message)


def whole(text: str) -> int:
    return int(text)


def parser() -> Parser:
    def common(p):
        p.add_argument("--path", "-p", default="./", help="what to scan")
        p.add_argument("--format", "-f", type=str.lower, choices=("console", "json", "sarif"), default="console")
        p.add_argument("--severity", "-s", type=requests.severity, default="medium", help="least severity to report")
        p.add_argument("--output", "-o", help="a file instead of the standard output")
        p.add_argument("--include-pii", action="store_true", help="authors and home folders are shown")
        p.add_argument("--color", type=str.lower, choices=("auto", "always", "never"), default="auto")

    top = Parser(prog="keelson", description="Finds hardcoded credentials and says where they are.")
    common(top)
    top.add_argument("--baseline", help="findings of this file are not reported")
    top.add_argument("--write-baseline", help="the findings go to this file")
    top.add_argument("--watch", action="store_true", help="scan files again when they change")
    for name in ("--include-generated", "--include-high-entropy", "--follow-symlinks"):
        top.add_argument(name, action="store_true")
    top.add_argument("--max-file-size", type=whole, help="bytes")
    top.add_argument("--include", nargs="+", action="extend", metavar="GLOB")
    top.add_argument("--exclude", nargs="+", action="extend", metavar="GLOB")
    past = top.add_subparsers(dest="verb").add_parser("history", help="scan the commits of a repository")
    common(past)
    past.add_argument("--branch", help="one branch instead of all")
    past.add_argument("--since", type=requests.instant, help="commits at or after this instant")
    past.add_argument("--max-commits", type=lambda text: requests.commits(int(text)), default=1000)
    for name in ("--all-history", "--still-present-only", "--removed-only", "--no-tags", "--include-unreachable", "--no-scan-commit-messages"):
        past.add_argument(name, action="store_true")
    return top


def shown(findings: DataFrame, o: argparse.Namespace, out: Out) -> None:
    if o.output and o.format != "console":
        {"json": report.save_json, "sarif": report.save_sarif}[o.format](findings, o.output)
        return
    text = "\n".join(report.console(findings)) if o.format == "console" else {"json": report.to_json, "sarif": report.to_sarif}[o.format](findings)
    if o.output:
        report.emit(text, o.output)
    else:
        out(report.coloured(text) if o.format == "console" and report.use_colour(o.color) else text)


def scan(spark: SparkSession, o: argparse.Namespace, out: Out) -> int:
    layers = config.load(o.path)
    flags = {k: getattr(o, k) for k in ("severity", "include", "exclude", "include_generated", "include_high_entropy", "follow_symlinks", "include_pii", "max_file_size")}
    engine = Engine(spark, options=config.scan_options(layers, **flags))
    if o.watch or config.truth(layers.get("watch", False)):
        return watched(engine, o, out)
    result = engine.scan(o.path, o.baseline or layers.get("baseline"))
    target = o.write_baseline or layers.get("writebaseline")
    if target:
        baseline.save(result.findings, target)
    o.output = o.output or layers.get("output")
    shown(result.findings, o, out)
    return result.exit_code()


def watched(engine: Engine, o: argparse.Namespace, out: Out, once: bool = False, since_ns: int | None = None) -> int:
    """Reports until it is interrupted."""
    from .streaming.watch import watch

    place = f"{shared_dir(engine.spark).rstrip('/')}/keelson-watch-{uuid.uuid4().hex}"
    query = watch(engine.spark, o.path, engine.library(), lambda df: shown(df, o, out), place, since_ns, once, lambda kind: print(f"error: {kind}", file=sys.stderr), engine.options)
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
    finally:
        remove(engine.spark, place)
    return 0


def past(spark: SparkSession, o: argparse.Namespace, out: Out) -> int:
    if o.still_present_only and o.removed_only:
        raise Wrong("choose one of --still-present-only and --removed-only")
    if git.toplevel(o.path if os.path.isdir(o.path) else os.path.dirname(o.path) or ".") is None:
        raise Wrong(f"not a git repository: {o.path}")
    engine = Engine(spark, options=ScanOptions(severity=o.severity, include_pii=o.include_pii))
    try:
        result = engine.scan_history(o.path, o.branch, o.since, None if o.all_history else o.max_commits, not o.no_tags, o.include_unreachable, not o.no_scan_commit_messages, refuse_over_cap=True)
    except OverCap as e:
        print(f"warning: {e.commits} commits can be reached and --max-commits is {e.cap}; nothing was scanned. --all-history scans them all, a larger --max-commits does too.", file=sys.stderr)
        return 2
    found = history.view(result.findings, o.still_present_only, o.removed_only)
    shown(found, o, out)
    return 0 if found.isEmpty() else 1


def session() -> SparkSession:
    """The session that is there, else a local one."""
    builder = SparkSession.builder if SparkSession.getActiveSession() else SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    return builder.getOrCreate()


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None, out: Out = print) -> int:
    try:
        o = parser().parse_args(arguments)
        if not os.path.exists(o.path):
            raise Wrong(f"path not found: {o.path}")
        return (past if o.verb == "history" else scan)(spark or session(), o, out)
    except Wrong as e:
        print(f"error: {e}", file=sys.stderr)
    except SystemExit as e:
        return int(e.code or 0)
    except Exception as e:  # noqa: BLE001
        print(f"error: {type(e).__name__}", file=sys.stderr)
    return 2
