"""History scans: matches on added lines, the earliest of each secret, whether it is still there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import Detector
from ..functions import exprs as X
from ..schemas import HISTORY
from .findings import message_findings
from .match import FACTS, matches, named


@dataclass
class History:
    """A history as tables: commits, refs, files as they are now (path, content), and the changes of some commits.

    diffs gets commits and their number, and gives a row for each file that one of them changed.
    """

    commits: DataFrame
    refs: DataFrame
    tree: DataFrame
    diffs: Callable[[DataFrame, int], DataFrame]

    @staticmethod
    def of_tables(commits: DataFrame, refs: DataFrame, tree: DataFrame, diffs: DataFrame) -> History:
        """From a table of all changes."""
        return History(commits, refs, tree, lambda some, _: diffs.join(some.select("sha"), "sha", "left_semi"))


def file_matches(commits: DataFrame, diffs: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Matches whose line a commit added, in files that are not deleted. Texts stay where they are read; commits meet matches only."""
    found = matches(diffs.where("status <> 'deleted'"), detectors, keep=("sha",), patch="patch").drop(*FACTS)
    # What a detector says of all its matches is put in behind the exchange, and half the digits of a hash are its bytes
    found = found.withColumn("hash16", F.unhex("hash16"))
    found = found.join(commits.select("sha", "author_when", F.coalesce("author_name", F.lit("(unknown)")).alias("author_name")), "sha")
    return named(found, detectors).withColumn("hash16", F.hex("hash16"))


#: Which match of a secret comes first.
ORDER = ("author_when", "sha", "file", "detector_order", "offset")


def earliest(found: DataFrame, detectors: tuple[Detector, ...] | None = None) -> DataFrame:
    """Of each secret (type and hash) the earliest match; ties by commit, file, detector, place. A minimum, so partial sums do some of it.

    The order and what goes along are one value, so that a commit and a file are exchanged once.
    detectors: those that found the matches, if known; what they say of all matches is then put in afterwards.
    Where nothing but the secrets is asked for, which match is first does not matter.
    """
    if set(found.columns) == {"secret_type", "hash16"}:
        return found.distinct()
    rows = found if detectors is None else found.drop("detector_id", "severity", "suggested_fix")
    rest = [c for c in rows.columns if c not in ("secret_type", "hash16", *ORDER)]
    # The hash goes first: rows are sorted by it, and types alone tell few of them apart
    first = rows.groupBy(F.unhex("hash16").alias("h"), "secret_type").agg(F.min(F.struct(*ORDER, *rest)).alias("x"))
    first = first.select("x.*", "secret_type", F.hex("h").alias("hash16"))
    if detectors is not None:
        first = named(first.drop("secret_type"), detectors)
    return first.select(*found.columns)


def with_presence(found: DataFrame, present: DataFrame) -> DataFrame:
    """still_present: whether the working tree holds the same type and hash anywhere."""
    keys = present.select("secret_type", "hash16").distinct().withColumn("still_present", F.lit(True))
    return found.join(keys, ["secret_type", "hash16"], "left").withColumn("still_present", F.coalesce("still_present", F.lit(False)))


def with_branches(found: DataFrame, membership: DataFrame) -> DataFrame:
    return found.join(membership, "sha", "left").withColumn("branches", F.coalesce("branches", F.array().cast("array<string>")))


def findings(commits: DataFrame, diffs: DataFrame, membership: DataFrame, present: DataFrame, detectors: tuple[Detector, ...], messages: bool = True, columns: tuple[str, ...] = HISTORY) -> DataFrame:
    """History and message findings in one wide schema, or these columns of it: what is not asked for is not exchanged."""
    wanted = {"secret_type", "hash16", *ORDER, *FACTS, *(x if x != "entropy" else "entropy_exact" for x in columns)}
    of = lambda found: earliest(found.select(*(c for c in found.columns if c in wanted)), detectors)
    files = of(file_matches(commits, diffs, detectors))
    return assembled(files, of(message_findings(commits, detectors)) if messages else None, membership, present, columns)


def assembled(files: DataFrame, messages: DataFrame | None, membership: DataFrame, present: DataFrame, columns: tuple[str, ...] = HISTORY) -> DataFrame:
    """The same from the earliest matches of either kind."""
    files = with_branches(with_presence(files, present), membership).withColumn("source", F.lit("history"))
    if messages is not None:
        files = files.unionByName(messages.withColumn("source", F.lit("commitMessage")), allowMissingColumns=True)
    if "entropy" in columns:
        files = files.withColumn("entropy", X.round_entropy(F.col("entropy_exact")))
    return files.withColumn("commit_sha", F.col("sha")).withColumn("commit_short", X.short_sha(F.col("sha"))).withColumn("commit_date", F.col("author_when")).select(*columns)


def view(found: DataFrame, still_present_only: bool = False, removed_only: bool = False) -> DataFrame:
    """One of the two views. Findings in messages belong to the removed only."""
    if still_present_only and removed_only:
        raise ValueError("still_present_only and removed_only exclude each other")
    if still_present_only:
        return found.where((F.col("source") == "history") & F.col("still_present"))
    if removed_only:
        return found.where((F.col("source") != "history") | ~F.col("still_present"))
    return found
