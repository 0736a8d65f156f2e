"""Public schemas. None has a column for a secret's value."""

from __future__ import annotations

FILES = "path string, content binary, size long"
CONTENTS = "path string, content string"
COMMITS = "sha string, parents array<string>, author_when timestamp, author_name string, message string"
REFS = "name string, kind string, sha string"
FILE_DIFFS = "sha string, path string, status string, patch string, content string"
BASELINE = "schemaVersion string, toolVersion string, entries array<struct<file:string,line:int,secretType:string,hint:string>>"
FINDING = ("source", "file", "line", "column", "secret_type", "severity", "hint", "entropy", "suggested_fix")
HISTORY = (*FINDING, "commit_sha", "commit_short", "commit_date", "author_name", "branches", "still_present")
FORBIDDEN = frozenset({"value", "secret", "raw", "content", "rawvalue", "secretvalue"})
HISTORY_ROWS = "source string, file string, line int, column int, secret_type string, severity string, hint string, entropy double, suggested_fix string, commit_sha string, commit_short string, commit_date timestamp, author_name string, branches array<string>, still_present boolean"
