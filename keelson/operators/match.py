"""Texts x detectors: all matches with their positions, as one scan.

One pass over a batch of texts finds all keywords and leaves pieces: the lines with a keyword for
detectors whose matches stay within a line, the whole text for the others. Pieces of a batch come by
detector, so that the expression is a column that hardly changes, compiled once a batch, and one
short piece of generated code serves all detectors. Positions come from the place of a single match,
or from the gaps between several, without a Python function. Values live in this stage only: what
leaves it are hints, entropies and hashes.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import Detector, severity_rank
from ..functions import exprs as X
from ..functions.keywords import Rule, pieces


def alone(regex: str) -> bool:
    """Whether no part of an expression looks at what stands before or behind a match."""
    bare = re.sub(r"\\[QE]", "$", regex)  # quotations are not looked into
    bare = re.sub(r"\[(?:\\.|[^\]\\])*\]", "", re.sub(r"\\[^AbBGzZ]", "", bare))
    return not re.search(r"[\^$\\\[]|\(\?<?[=!]", bare)


def extracted(content: Column, regex: Column, before: Column, value: Column, key: Column, apart: Column) -> Column:
    """What an expression finds in a text: the matches, what lies between them, and the groups of these numbers, null for none."""
    every = F.regexp_extract_all(content, regex, F.lit(0))

    def group(n: Column) -> Column:
        # What an expression makes of a match alone is what it made of it in the text, if it does not look around
        found = F.when(apart, F.transform(every, lambda w: F.call_function("regexp_extract", w, regex, n))).otherwise(F.regexp_extract_all(content, regex, n))
        return F.when(n.isNotNull(), found)

    return F.struct(every.alias("whole"), F.split(content, regex, -1).alias("gaps"), group(before).alias("before"), group(value).alias("value"), group(key).alias("key"))


def of_detectors(order: Column, detectors: tuple[Detector, ...]) -> tuple[Column, ...]:
    """What extracted needs besides a text, of the detector with this number."""
    each = lambda f, kind: F.get(F.array(*(F.lit(f(d)).cast(kind) for d in detectors)), order)
    return (
        each(lambda d: d.regex, "string"),
        each(lambda d: 1 if d.value_group else None, "int"),
        each(lambda d: d.value_group or None, "int"),
        each(lambda d: d.key_group, "int"),
        each(lambda d: alone(d.regex), "boolean"),
    )


#: Pieces whose lengths are summed up one by one; beyond it by blocks.
STEP = 64


def measure(text: Column) -> Column:
    """(size, feeds, tail): characters, line feeds, characters after the last of them."""
    return F.struct(F.length(text).alias("size"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("feeds"), F.length(F.substring_index(text, "\n", -1)).alias("tail"))


def then(a: Column, b: Column) -> Column:
    """The measure of two texts in a row."""
    return F.struct((a["size"] + b["size"]).alias("size"), (a["feeds"] + b["feeds"]).alias("feeds"), F.when(b["feeds"] > 0, b["tail"]).otherwise(a["tail"] + b["tail"]).alias("tail"))


def occurrences(x: Column) -> Column:
    """Array of (offset, line, column, v, k): 0-based place of the value in the text, its line and column, the value, the key or null.

    The text is measured between matches, each stretch once; sums run over blocks of STEP matches.
    """
    return X.bound(x, placed_all)


def placed_all(x: Column) -> Column:
    nothing = F.struct(F.lit(0).alias("size"), F.lit(0).alias("feeds"), F.lit(0).alias("tail"))
    total = lambda a: F.aggregate(a, nothing, then)
    many = F.size(x["whole"])
    blocks = F.sequence(F.lit(0), F.floor((many - 1) / STEP).cast("int"))
    stretches = F.transform(x["whole"], lambda _, i: measure(F.concat(F.when(i == 0, F.lit("")).otherwise(F.get(x["whole"], i - 1)), F.get(x["gaps"], i))))

    def placed(chunks):
        heads = X.bound(F.transform(chunks, total), lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))))

        def place(heads):
            def one(w, i):
                block = F.floor(i / STEP).cast("int")
                at = F.aggregate(F.slice(F.get(chunks, block), F.lit(1), i % STEP + 1), F.get(heads, block), then)
                at = then(at, measure(F.coalesce(F.get(x["before"], i), F.lit(""))))
                return X.bound(at, lambda p: F.struct(p["size"].alias("offset"), (p["feeds"] + 1).alias("line"), (p["tail"] + 1).alias("column"), F.coalesce(F.get(x["value"], i), w).alias("v"), F.get(x["key"], i).alias("k")))

            return F.transform(x["whole"], one)

        return X.bound(heads, place)

    chunked = lambda pieces: F.transform(blocks, lambda b: F.slice(pieces, b * STEP + 1, F.lit(STEP)))
    return X.bound(X.bound(stretches, chunked), placed)


def matches(texts: DataFrame, detectors: tuple[Detector, ...], path: str = "path", content: str = "content", check_extension: bool = True, keep: tuple[str, ...] = (), patch: str | None = None) -> DataFrame:
    """A row for each match that holds up: keep, path as file, place, masked facts. Rejected: no value, placeholders, low entropy.

    The text itself is not kept. entropy_exact is not rounded. patch: a column of patches; only
    matches on lines that they add count, which is settled before matches become rows.
    """
    if not detectors:
        raise ValueError("no detectors")
    changes = [] if patch is None else [F.col(patch).alias("patch")]
    row = texts.select(*keep, *changes, F.col(path).alias("file"), F.col(content).alias("content"), X.extension(F.col(path)).alias("ext"))
    rules = [Rule(d.extensions if check_extension else (), d.keywords, d.one_line) for d in detectors]
    row = pieces(row, (*keep, "file"), rules)
    regex, before, value, key, apart = of_detectors(F.col("which"), detectors)
    row = row.select("*", regex.alias("rx"), before.alias("b"), value.alias("g"), key.alias("k"), apart.alias("apart"))
    row = row.select("*", F.regexp_extract_all("text", F.col("rx"), F.lit(0)).alias("whole"))
    # Mostly there is one match, and its text stands nowhere else: no sums, no inner functions
    first = F.get("whole", F.lit(0))
    single = (F.size("whole") == 1) & (F.call_function("substring_index", F.col("text"), first, F.lit(2)) == F.col("text"))
    group = lambda n: F.call_function("regexp_extract", F.when(F.col("apart"), first).otherwise(F.col("text")), F.col("rx"), F.col(n))
    head = F.concat(F.call_function("substring_index", F.col("text"), first, F.lit(1)), F.coalesce(group("b"), F.lit("")))
    counts = lambda line: F.col("sure") | F.coalesce(F.substring("lines", line, F.lit(1)) == F.unhex(F.lit("01")), F.lit(False))
    nowhere = F.lit(None).cast("struct<offset:int,line:int,column:int>")
    # The key is looked for in what was matched later, if a hint is asked for
    matched = F.when(F.col("apart"), first)
    late = F.when(~F.col("apart"), group("k"))
    one = F.array(F.struct(head.alias("head"), nowhere.alias("at"), F.coalesce(group("g"), first).alias("v"), late.alias("k"), matched.alias("w"), counts(measure(head)["feeds"] + 1).alias("counts")))
    many = occurrences(extracted(F.col("text"), *(F.col(c) for c in ("rx", "b", "g", "k", "apart"))))
    many = F.transform(many, lambda m: F.struct(F.lit(None).cast("string").alias("head"), F.struct(m["offset"].alias("offset"), m["line"].alias("line"), m["column"].alias("column")).alias("at"), m["v"].alias("v"), m["k"].alias("k"), F.lit(None).cast("string").alias("w"), counts(m["line"]).alias("counts")))
    found = F.when(single, one).when(F.size("whole") > 0, many)
    # Outer, or else a filter on sizes would be put in, further down in the plan, and find all matches a second time
    row = row.select(*keep, "file", "which", "offset", "line", found.alias("found")).select(*keep, "file", "which", "offset", "line", F.explode_outer("found").alias("m"))
    v, (regex, *_, key, _) = F.col("m.v"), of_detectors(F.col("which"), detectors)
    k = F.coalesce(F.col("m.k"), F.call_function("regexp_extract", F.col("m.w"), regex, key))
    numbers = lambda f: F.get(F.array(*(F.lit(f(d)) for d in detectors)), F.col("which"))
    row = row.where(F.col("m.counts") & (v != "")).where(~numbers(lambda d: d.reject_placeholders) | ~X.is_placeholder(v))
    at = measure(F.col("m.head"))
    place = lambda here, name, more: (F.coalesce(here, F.col(f"m.at.{name}")) + more).alias(name)
    row = row.select(
        *keep,
        "file",
        F.col("which").alias("detector_order"),
        place(at["feeds"] + 1, "line", F.col("line")),
        place(at["tail"] + 1, "column", F.lit(0)),
        place(at["size"], "offset", F.col("offset")),
        X.hint(F.get(F.array(*(F.lit(d.secret_type) for d in detectors)), F.col("which")), k, v).alias("hint"),
        X.entropy(v).alias("entropy_exact"),
        X.hash16(v).alias("hash16"),
    )
    if any(d.min_entropy is not None for d in detectors):
        least = F.get(F.array(*(F.lit(d.min_entropy).cast("double") for d in detectors)), F.col("detector_order"))
        row = row.where(least.isNull() | (F.col("entropy_exact") >= least))
    return named(row, detectors)


#: What a detector says of all its matches.
FACTS = ("detector_id", "secret_type", "severity", "suggested_fix")


def named(rows: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Matches without FACTS, with them: known by detector_order, they need not be exchanged."""
    known = {f: F.array(*(F.lit(d.id if f == "detector_id" else getattr(d, f)) for d in detectors)) for f in FACTS}
    return rows.select("*", *(F.element_at(x, F.col("detector_order") + 1).alias(f) for f, x in known.items()))


def theta(texts: DataFrame, detectors: tuple[Detector, ...], spark) -> DataFrame:
    """(file, detector_id) that may match, relationally: the catalogue, of a fixed size, is broadcast against the texts."""
    table = spark.createDataFrame([(d.id, severity_rank(d.severity), list(d.extensions), [k.lower() for k in d.keywords]) for d in detectors], "detector_id string, rank int, extensions array<string>, keywords array<string>")
    row = texts.select(F.col("path").alias("file"), F.lower("content").alias("lc"), X.extension(F.col("path")).alias("ext")).where(F.length("lc") > 0)
    fits = (F.size("extensions") == 0) | F.array_contains("extensions", F.col("ext"))
    some = (F.size("keywords") == 0) | F.exists("keywords", lambda w: F.contains(F.col("lc"), w))
    return row.join(F.broadcast(table), fits & some).select("file", "detector_id")
