"""Changes between snapshots that are held as tables: no repository is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linediff import patched
from ..sources.shared import stored
from .history import History

#: Bytes that two files have to share, of the larger one, for one to be the other renamed.
ALIKE = 0.5


def file_changes(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(sha, path, status, patch, content) of each commit against its first parent, as of a repository.

    files: (sha, path, content), all files of each commit; null contents are binary and have no patch.
    """
    pair = commits.select("sha", F.get("parents", F.lit(0)).alias("parent"))
    now = pair.join(files, "sha").select("sha", "path", "content", F.lit(True).alias("now"))
    then = pair.join(files.select(F.col("sha").alias("parent"), "path", F.col("content").alias("before")), "parent").select("sha", "path", "before", F.lit(True).alias("then"))
    rows = now.join(then, ["sha", "path"], "full").where("now is null or then is null or not (content <=> before)")
    rows = stored(rows, "changes")
    both = rows.where("now and then").withColumn("status", F.lit("modified"))
    came, went = rows.where("then is null").select("sha", "path", "content"), rows.where("now is null").select("sha", "path", "before")
    moved = renames(came, went.withColumnRenamed("before", "content"))
    gone = went.join(moved.select("sha", F.col("old").alias("path")), ["sha", "path"], "left_anti")
    old = moved.join(went.withColumnRenamed("path", "old"), ["sha", "old"]).select("sha", "path", "before")
    fresh = came.join(old, ["sha", "path"], "left")
    named = moved.select("sha", "path", F.lit("renamed").alias("status"))
    fresh = fresh.join(named, ["sha", "path"], "left").withColumn("status", F.coalesce("status", F.lit("added")))
    some = both.select("sha", "path", "status", "before", "content").unionByName(fresh.select("sha", "path", "status", "before", "content"))
    text = F.when(F.col("content").isNull(), "").otherwise(patched(F.col("before"), F.col("content")))
    none = gone.select("sha", "path", F.lit("deleted").alias("status"), F.lit("").alias("patch"), F.lit("").alias("content"))
    return some.select("sha", "path", "status", text.alias("patch"), F.coalesce("content", F.lit("")).alias("content")).unionByName(none)


def chunks(files: DataFrame) -> DataFrame:
    """(sha, path, chunk, bytes, size): the distinct lines of each file with all the bytes they take, and those of the file."""
    line = files.where("length(content) > 0").select("sha", "path", F.octet_length("content").alias("size"), F.explode(F.split("content", "\n", -1)).alias("line"))
    line = line.select("sha", "path", "size", F.xxhash64("line").alias("chunk"), (F.octet_length("line") + 1).cast("long").alias("n"))
    return line.groupBy("sha", "path", "size", "chunk").agg(F.sum("n").alias("bytes"))


def renames(came: DataFrame, went: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(sha, path, old) of files that came and files that went in one commit and share enough lines; the most alike first, each once.

    A pair that shares a share of the larger file shares one of the rarest lines that make up the
    rest of the smaller: only files that meet in one of those are compared, so that lines which all
    files of a commit hold bring none together.
    """
    new, old = stored(chunks(came), "chunks"), stored(chunks(went), "chunks")
    seen = new.select("sha", "chunk").unionByName(old.select("sha", "chunk")).groupBy("sha", "chunk").agg(F.count("*").alias("files"))
    order = Window.partitionBy("sha", "path").orderBy("files", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    rare = new.join(seen, ["sha", "chunk"]).withColumn("passed", F.coalesce(F.sum("bytes").over(order), F.lit(0))).where(F.col("passed") <= F.col("size") + 1 - alike * F.col("size"))
    meet = rare.select("sha", "path", "chunk").join(old.select("sha", F.col("path").alias("old"), "chunk"), ["sha", "chunk"]).select("sha", "path", "old").distinct()
    theirs = old.select("sha", F.col("path").alias("old"), "chunk", F.col("bytes").alias("bytes_old"), F.col("size").alias("size_old"))
    both = meet.join(new, ["sha", "path"]).join(theirs, ["sha", "old", "chunk"])
    score = both.groupBy("sha", "path", "old", "size", "size_old").agg(F.sum(F.least("bytes", "bytes_old")).alias("shared"))
    score = score.withColumn("alike", F.least(F.col("shared") / F.greatest("size", "size_old"), F.lit(1.0))).where(F.col("alike") >= alike).select("sha", "path", "old", "alike")
    left, found = stored(score, "alike"), None
    # The most alike of each side for each other; then again among those that are left
    while not left.isEmpty():
        best = lambda side, other: F.row_number().over(Window.partitionBy("sha", side).orderBy(F.desc("alike"), other))
        pairs = left.withColumn("a", best("path", "old")).withColumn("b", best("old", "path")).where("a = 1 and b = 1").select("sha", "path", "old")
        pairs = stored(pairs, "renames")
        found = pairs if found is None else found.unionByName(pairs)
        left = stored(left.join(pairs.select("sha", "path"), ["sha", "path"], "left_anti").join(pairs.select("sha", "old"), ["sha", "old"], "left_anti"), "alike")
    return found if found is not None else score.select("sha", "path", "old")


def history(commits: DataFrame, refs: DataFrame, files: DataFrame, head: str) -> History:
    """A history from snapshots; the working tree is that of the commit head."""
    tree = files.where((F.col("sha") == head) & F.col("content").isNotNull()).select("path", "content")
    return History(commits, refs, tree, lambda some, _: file_changes(some, files))
