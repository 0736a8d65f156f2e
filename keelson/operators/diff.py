"""Added lines of unified patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X


def added_lines(diffs: DataFrame, fix_plus_lines: bool = False) -> DataFrame:
    """(sha, path, line, text) of each added line. Built-in functions only, without inner functions, in proportion to the lines.

    Text before the first `@@` is skipped; `@@` sets the number; `+` lines are added and advance
    it; `-` and `\\` do not; anything else does. A line that starts with `+++` within a hunk is
    dropped and does not advance it, unless fix_plus_lines.
    """
    text = F.replace(F.replace(F.coalesce("patch", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # A final line feed gives an empty line at the end, which is none of those added
    hunks = diffs.select("sha", "path", F.posexplode(F.split(F.concat(F.lit("\n"), text), "\n(?=@@)", -1)).alias("i", "hunk")).where("i > 0")
    hunks = hunks.select("sha", "path", X.hunk_start(F.substring_index("hunk", "\n", 1)).alias("start"), "hunk")
    # Without the lines that do not advance, the place among the rest is the number; the header is line 0
    other = r"\n(?:-|\\" + ("" if fix_plus_lines else r"|\+\+\+") + r")[^\n]*"
    counted = F.split(F.regexp_replace("hunk", other, ""), "\n", -1)
    lines = hunks.select("sha", "path", "start", F.posexplode(counted).alias("at", "x"))
    return lines.where(F.col("x").startswith("+") & (F.col("at") > 0)).select("sha", "path", (F.col("start") + (F.col("at") - 1)).cast("int").alias("line"), F.substring("x", F.lit(2), F.length("x")).alias("text"))


def enumerate_added(patch: str | None, fix_plus_lines: bool = False) -> list[tuple[int, str]]:
    """The same rules for one patch; the table function of SQL uses it."""
    out, at = [], -1
    for x in (patch or "").replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n"):
        if x.startswith("@@"):
            digits = "".join(c for c in _until_other(x.partition("+")[2]))
            # What is no 32-bit number counts as none
            at = int(digits) if digits and int(digits) < 1 << 31 else 1
        elif at < 0 or x.startswith(("-", "\\")) or (x.startswith("+++") and not fix_plus_lines):
            continue
        else:
            if x.startswith("+"):
                out.append((at, x[1:]))
            at += 1
    return out


def _until_other(text: str):
    for c in text:
        if not c.isdigit():
            return
        yield c


def register_sql(spark: SparkSession) -> None:
    """SQL: SELECT * FROM added_lines(patch), or beside a table of patches: FROM t, LATERAL added_lines(t.patch)."""
    import pyarrow as pa

    @F.arrow_udtf(returnType="line int, text string")
    class AddedLines:
        def eval(self, patch: pa.Array):
            for one in patch.to_pylist():
                found = enumerate_added(one)
                yield pa.table({"line": pa.array([n for n, _ in found], pa.int32()), "text": pa.array([t for _, t in found], pa.string())})

    spark.udtf.register("added_lines", AddedLines)
