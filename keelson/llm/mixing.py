"""Mixing sources to target weights by temperature (operator 3). DataFrame operations only.

Sources' token shares are raised to an exponent and normalised. The exponent is the largest
in [0, 1], in steps of 2**-20, whose weights have at least the target entropy (a share of the
logarithm of the number of sources; flatter is higher); if it would repeat a source more than
max_repeats times, it is raised to the least exponent that does not. Both conditions are
monotone, so the interval is cut in 32 four times, each time with one small aggregation. Then
weights become documents: a source's target is its weight times the budget; it gives all its
documents as often as they fit, and a permutation of them gives the rest. The permutation is
made of blocks of about BLOCK documents by hash; whole blocks are taken while they fit, and
within blocks documents are taken in order of hash as long as the sum fits. No source is ever
sorted as a whole: sums run over superblocks, blocks and documents, each bounded.

Tokens are words, `[^\\x20\\x09-\\x0D]+`. Null texts and texts without words have none and
follow the documents around them; a null source is the source ''; a null doc_id counts as a
document of its own. Repeated rows count each. If there are no tokens at all, every weight is
0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK, SUPERBLOCK, STEPS = 1024, 1024, 20
ENTROPY, MAX_REPEATS, SEED = 0.97, 4.0, "mix-1"


def exponent(sources: DataFrame, budget: float, entropy: float, max_repeats: float) -> int:
    """In steps of 2**-STEPS, from the tokens of each source."""

    def cut(condition: str, low: int, high: int) -> int:
        """The largest step in [low, high) with the condition, which holds up to some step; low if for none above."""
        while high - low > 1:
            step = max(1, (high - low) // 32)
            grid = sources.select("tokens", F.explode(F.sequence(F.lit(low), F.lit(high - 1), F.lit(step))).alias("k"))
            x = F.col("k") / F.lit(float(1 << STEPS))
            share = F.pow(F.col("tokens") / F.lit(budget), x)
            sums = grid.withColumn("x", x).withColumn("s", share).groupBy("k").agg(F.count("*").alias("n"), F.sum("s").alias("z"), F.sum(F.expr(f"s * x * ln(tokens / double('{budget!r}'))")).alias("e"), F.max(F.expr(f"s * double('{budget!r}') / tokens")).alias("r"))
            rows = {r.k for r in sums.where(condition).select("k").collect()}
            low, high = (best := max(rows | {low})), min(high, best + step)
        return low

    steps = 1 << STEPS
    flat = cut(f"ln(z) - e / z >= {entropy!r} * ln(n)", 0, steps + 1)
    # One above the largest step that still repeats too often
    often = cut(f"r / z > {max_repeats!r}", -1, steps)
    return max(flat, often + 1)


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """A row for each document: source, tokens, weight of its source, how often it is taken, block and place in it.

    budget: tokens of the mixture; by default as many as there are.
    """
    word = F.lit("[^\\x20\\x09-\\x0D]+")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), word), F.lit(0)).cast("long").alias("n_tokens"))
    rows = stored(rows, "tokens").withColumn("digest", digest)
    everything = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    sources = everything.where("tokens > 0")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    x = exponent(sources, float(total), entropy, max_repeats) / (1 << STEPS) if total else 1.0
    budget = total if budget is None else budget
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(x))).otherwise(F.lit(0.0))
    norm = sources.agg(F.coalesce(F.sum(F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(x))), F.lit(1.0))).first()[0]
    plan = everything.select("source", "tokens", (power / F.lit(norm)).alias("weight"), F.expr(f"ceil(n / {BLOCK})").cast("long").alias("blocks"))
    plan = plan.withColumn("goal", F.floor(F.col("weight") * F.lit(budget)).cast("long"))
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("goal div tokens")).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.expr("goal - whole * tokens"))
    rows = rows.join(plan.select("source", "blocks"), "source").withColumn("block", F.expr("pmod(cast(conv(substr(digest, 1, 12), 16, 10) as bigint), blocks)"))
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).withColumn("super", F.expr(f"block div {SUPERBLOCK}"))
    before = Window.orderBy("super").partitionBy("source").rowsBetween(Window.unboundedPreceding, -1)
    supers = sums.groupBy("source", "super").agg(F.sum("tokens").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    within = Window.partitionBy("source", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(supers, ["source", "super"])
    blocks = sums.join(plan.select("source", "weight", "whole", "rest"), "source").select("source", "block", "weight", "whole", "rest", (F.col("base") + F.col("inner")).alias("begin"))
    inside = Window.partitionBy("source", "block").orderBy("digest", "doc_id", "n_tokens")
    out = rows.join(blocks, ["source", "block"]).withColumn("place", F.row_number().over(inside)).withColumn("upto", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    extra = (F.col("begin") + F.col("upto") <= F.col("rest")).cast("long")
    return out.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), (F.col("whole") + extra).alias("copies"), "block", F.col("place").cast("long").alias("place"))
