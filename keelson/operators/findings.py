"""From matches to findings: projections, filters, redaction, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import MESSAGE_FILE, REDACTED_AUTHOR, Detector
from ..functions import exprs as X
from ..schemas import FINDING
from .match import matches

ORDER = ("file", "line", "column", "detector_order", "offset")


def working_tree(texts: DataFrame, detectors: tuple[Detector, ...], keep_keys: bool = False) -> DataFrame:
    """Findings of file texts (path, content)."""
    m = matches(texts, detectors)
    rows = m.withColumn("source", F.lit("workingTree")).withColumn("entropy", X.round_entropy(F.col("entropy_exact")))
    return rows.select(*FINDING, *(("detector_id", "detector_order", "offset", "hash16") if keep_keys else ()))


def redacted(findings: DataFrame, include_pii: bool = False) -> DataFrame:
    """Home folders and authors hidden: file in trees and history, author in history and messages."""
    if include_pii:
        return findings
    out = findings.withColumn("file", F.when(F.col("source") == "commitMessage", F.col("file")).otherwise(X.redact_home(F.col("file"))))
    if "author_name" in findings.columns:
        out = out.withColumn("author_name", F.when(F.col("source").isin("history", "commitMessage"), F.lit(REDACTED_AUTHOR)).otherwise(F.col("author_name")))
    return out


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def by_file(findings: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("line", "column", "secret_type")))
    return findings.groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["line"].cast("string"), r["column"].cast("string"), r["secret_type"])), ",").alias("places"))


def rules(findings: DataFrame) -> DataFrame:
    return findings.select("secret_type").distinct()


def limited(files: DataFrame, most: int | None) -> tuple[DataFrame, bool]:
    """The first files by path, and whether there are more. Only paths are put in order, and one comes to the driver."""
    if most is None:
        return files, False
    seen = files.select("path").orderBy("path").limit(most + 1).agg(F.count("*").alias("n"), F.max("path").alias("last")).first()
    return (files, False) if seen.n <= most else (files.where(F.col("path") < seen["last"]), True)


def message_findings(commits: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Matches in commit messages; extensions do not count."""
    rows = commits.where(F.coalesce(F.col("message"), F.lit("")) != "").select("sha", "author_when", F.coalesce("author_name", F.lit("(unknown)")).alias("author_name"), F.lit(MESSAGE_FILE).alias("path"), F.col("message").alias("content"))
    return matches(rows, detectors, check_extension=False, keep=("sha", "author_when", "author_name"))
