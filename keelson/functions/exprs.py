"""Scalar rules as Column expressions; all of them stay in generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogue import BINARY_EXTENSIONS, DEFAULT_EXCLUDES, GENERATED_EXCLUDES, MASK, PLACEHOLDERS


def is_placeholder(value: Column) -> Column:
    """Blank, a known stand-in in any case, or made of `* x X _ . ?` alone; quotes and white space around it do not count."""
    bare = F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    bare = F.regexp_replace(bare, "^[\"']+|[\"']+$", "")
    stands_in = lambda b: (b == "") | F.lower(b).isin(PLACEHOLDERS) | b.rlike(r"^[*xX_.?]*$")
    # Most values have nothing around them: one look instead of two copies
    edges = F.concat(F.substring(value, 1, 1), F.substring(value, -1, 1))
    return F.when(edges.rlike(r"[\s\p{Z}\"']"), stands_in(bare)).otherwise(stands_in(value))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character, over characters below U+0100; 0 without any. Not rounded.

    A character is counted by what its removal takes from the length, once for each that is there.
    """

    def of(v):
        n = F.length(v).cast("double")
        kinds = F.array_sort(F.filter(F.array_distinct(F.split(v, "")), lambda c: c != ""))
        share = F.transform(kinds, lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n)
        return F.when(F.length(v) > 0, F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)

    return bound(F.regexp_replace(value, r"[^\x00-\xFF]+", ""), of)


def round_entropy(e: Column) -> Column:
    return F.round(e, 1)


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_safe_key(key: Column) -> Column:
    return F.coalesce(key.rlike(r"^[\p{L}\p{Nd}_.:-]+$"), F.lit(False))


def bleeds(candidate: Column, value: Column, width: int = 4) -> Column:
    """Whether a window of width characters of the value stands in the candidate, and so one of the candidate, which is short, in the value."""
    windows = F.transform(F.sequence(F.lit(1), F.length(candidate) - (width - 1)), lambda i: F.substring(candidate, i, F.lit(width)))
    return F.when((F.length(value) >= width) & (F.length(candidate) >= width), F.exists(windows, lambda w: F.contains(value, w))).otherwise(F.lit(False))


def hint(secret_type: Column, key: Column, value: Column) -> Column:
    """The key as written, masked; the type instead if the key is unfit or would show part of the value."""
    named = F.concat(key, F.lit(f"={MASK}"))
    return F.when(is_safe_key(key) & ~bleeds(named, value), named).otherwise(F.concat(secret_type, F.lit(f"={MASK}")))


def hash16(value: Column) -> Column:
    return F.upper(F.substring(F.sha2(value, 256), 1, 32))


def redact_home(path: Column) -> Column:
    """A home folder at the start becomes `~`, and what follows takes `/`."""
    pattern = r"(?i)^(?:/Users/[^/\\]+|/home/[^/\\]+|[A-Z]:\\Users\\[^/\\]+)"
    rest = F.replace(F.regexp_replace(F.regexp_replace(path, pattern, ""), r"^[/\\]+", ""), F.lit("\\"), F.lit("/"))
    return F.when(path.rlike(pattern), F.when(rest == "", F.lit("~")).otherwise(F.concat(F.lit("~/"), rest))).otherwise(path)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").when(severity == "low", "note")


def severity_order(severity: Column) -> Column:
    return F.when(severity == "critical", 3).when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def hunk_start(header: Column) -> Column:
    """The first new line of a hunk: digits after the first plus sign, or 1."""
    return F.coalesce(F.regexp_extract(header, r"^[^+]*\+(\d*)", 1).try_cast("int"), F.lit(1))


def glob_regex(glob: str) -> str:
    """`**/` is any folders, `**` anything, `*` anything within a name, `?` one character of it."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"(?i)^{out}$"


def matches_any(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(glob_regex(g)) for g in globs), F.lit(False))


def in_scope(path: Column, include: tuple[str, ...] = ("**/*",), exclude: tuple[str, ...] = (), generated: bool = False) -> Column:
    """Included, and neither excluded by default, nor generated unless asked for, nor excluded by the user."""
    dropped = [*DEFAULT_EXCLUDES, *(() if generated else GENERATED_EXCLUDES), *exclude]
    return matches_any(path, include or ("**/*",)) & ~matches_any(path, dropped)


def is_binary_name(path: Column) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def has_keyword(lowered: Column, keywords: tuple[str, ...] | list[str]) -> Column:
    """Any of the keywords in text that is in lower case already; no keywords pass everything."""
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(k.lower())) for k in keywords)) if keywords else F.lit(True)


def history_details(short: Column, when: Column, branches: Column, present: Column) -> Column:
    where = F.when(F.size(branches) > 0, F.array_join(branches, ", ")).otherwise("(detached)")
    state = F.when(present, "still present").otherwise("removed from working tree")
    return F.concat(F.lit("commit "), short, F.lit(" "), F.date_format(when, "yyyy-MM-dd"), F.lit(" ["), where, F.lit("] - "), state)
