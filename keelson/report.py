"""Reports: console text, JSON, SARIF, the wire format of agents."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import SCHEMA_VERSION, TOOL_VERSION
from .functions import exprs as X
from .sources import sink

CAMEL = {"secret_type": "secretType", "suggested_fix": "suggestedFix", "commit_sha": "commitSha", "commit_short": "commitShort", "commit_date": "commitDate", "author_name": "authorName", "still_present": "stillPresent"}


def summary_line(findings: DataFrame) -> str:
    n = {r.severity: r.n for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    return f"{total} finding{'' if total == 1 else 's'}: " + ", ".join(f"{n.get(s, 0)} {s}" for s in ("critical", "high", "medium", "low"))


def console(findings: DataFrame) -> Iterator[str]:
    """Lines by file, line, column; streamed, not collected."""
    details = F.lit(None).cast("string")
    if "branches" in findings.columns:
        message = F.concat(F.lit("commit "), F.col("commit_short"), F.lit(" "), F.date_format("commit_date", "yyyy-MM-dd"), F.lit(" (commit message)"))
        details = F.when(F.col("source") == "history", X.history_details(F.col("commit_short"), F.col("commit_date"), F.col("branches"), F.col("still_present"))).when(F.col("source") == "commitMessage", message)
    rows = findings.withColumn("details", details).orderBy("file", "line", "column")
    last, some = None, False
    for r in rows.toLocalIterator():
        if r.file != last:
            yield ""
            yield r.file
            last = r.file
        some = True
        yield f"  {r.line:>4}:{r.column:<3} {r.severity:<8} {r.secret_type:<22} {r.hint}"
        if r.details:
            yield f"       → {r.details}"
        if r.suggested_fix:
            yield f"       → {r.suggested_fix}"
    if not some:
        yield "No findings."
    else:
        yield ""
        yield summary_line(findings)


#: Columns that a scan adds for its own use.
OWN = ("detector_id", "detector_order", "offset", "hash16")
ORDER = ("file", "line", "column")


def items(findings: DataFrame, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """The JSON text of each finding, under the names of reports, without what is null; in order."""
    names = [c for c in findings.columns if c not in (*leave_out, *OWN)]
    shown = [(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX") if c == "commit_date" else F.col(c)).alias(CAMEL.get(c, c)) for c in names]
    return findings.orderBy(*ORDER).select(F.to_json(F.struct(*shown)).alias("item"))


def dictionaries(findings: DataFrame, leave_out: tuple[str, ...] = ()) -> Iterator[dict[str, Any]]:
    for r in items(findings, leave_out).toLocalIterator():
        yield json.loads(r[0])


def json_body(rows: list) -> dict[str, Any]:
    return {"schemaVersion": SCHEMA_VERSION, "toolVersion": TOOL_VERSION, "findings": rows}


def to_json(findings: DataFrame) -> str:
    return json.dumps(json_body(list(dictionaries(findings))), indent=2, ensure_ascii=False)


def save_json(findings: DataFrame, path: str) -> None:
    """to_json as a file, written by tasks."""
    sink.save(items(findings), path, json_body)


def to_wire(findings: DataFrame | None, truncated: bool = False, error: str | None = None, **facts: Any) -> str:
    """For agents: no entropy, no authors. facts: what the scan counted."""
    rows = [] if findings is None else list(dictionaries(findings, ("entropy", "author_name")))
    body = {"schemaVersion": SCHEMA_VERSION, "truncated": truncated, "truncatedReason": "a limit of time or number was reached" if truncated else None, **facts, "findings": rows, "error": error}
    return json.dumps({k: v for k, v in body.items() if v is not None}, ensure_ascii=False)


def sarif_items(findings: DataFrame) -> DataFrame:
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    text = F.concat("hint", F.lit(" ("), "secret_type", F.lit(") — "), F.coalesce("suggested_fix", F.lit("")))
    row = F.struct(F.col("secret_type").alias("ruleId"), X.sarif_level(F.col("severity")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.orderBy(*ORDER).select(F.to_json(row).alias("item"))


def sarif_body(findings: DataFrame):
    """The report around its results. Rules are as many as detectors at most."""
    types = [r[0] for r in findings.select("secret_type").distinct().orderBy("secret_type").collect()]
    rules = [{"id": t, "name": t, "shortDescription": {"text": t}, "fullDescription": {"text": f"Detection rule for {t} secrets."}, "defaultConfiguration": {"level": "error"}} for t in types]
    driver = {"name": "keelson", "version": TOOL_VERSION, "semanticVersion": TOOL_VERSION, "rules": rules}
    return lambda results: {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}


def to_sarif(findings: DataFrame) -> str:
    return json.dumps(sarif_body(findings)([json.loads(r[0]) for r in sarif_items(findings).toLocalIterator()]), indent=2, ensure_ascii=False)


def save_sarif(findings: DataFrame, path: str) -> None:
    """to_sarif as a file, written by tasks."""
    sink.save(sarif_items(findings), path, sarif_body(findings))


# Colours of severities on a terminal
COLOURS = {"critical": "\x1b[1;31m", "high": "\x1b[31m", "medium": "\x1b[33m", "low": "\x1b[36m"}


def coloured(text: str) -> str:
    """Console lines with their severity in colour."""
    return "\n".join(re.sub(r"^(\s+\d+:\d+\s+)(critical|high|medium|low)\b", lambda m: f"{m[1]}{COLOURS[m[2]]}{m[2]}\x1b[0m", line) for line in text.split("\n"))


def use_colour(choice: str = "auto", stream=None, environment: dict[str, str] | None = None) -> bool:
    env = os.environ if environment is None else environment
    if choice in ("always", "never"):
        return choice == "always"
    if env.get("FORCE_COLOR"):
        return True
    if env.get("NO_COLOR"):
        return False
    return bool(getattr(stream or sys.stdout, "isatty", lambda: False)())


def emit(text: str, path: str | None = None) -> None:
    if path is None:
        print(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")
