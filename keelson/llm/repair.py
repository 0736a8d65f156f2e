"""Repair of the structure of conversations (operator 13).

A good conversation is empty, or an optional system turn and then user and assistant by turns:
role initials `(s?(ua)+)?`. Blank and duplicate turns have to go. Edits have costs; a conversation
is a graph of (turns read, state of the pattern) with an arc for each edit. Least costs from the
start to each node (forward) and from each node to the end (backward) tell which arcs lie on a
cheapest way: those whose cost and the two sums around them make the total. From the start, the
set of nodes reached follows the tight arcs of the least letter, step by step, which spells the
least of all cheapest edits (D < I < K < R).

Turns go by conv_id to tasks, once, and are sorted there; a task holds one conversation at a time
(its edits are one value of the result). Order: turn, nulls first, ties by role and text. Null
roles and texts are one space; so are null ids and turns where they are hashed. Rows without
conv_id are one conversation, without an id. An empty role has no initial: kept, it changes
nothing in the pattern. Very long texts are taken whole. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

WHITE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: States: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS, FAR = range(4), (0, 3), 1 << 60
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: one row in five is damaged, by crc32 of `conv_id:turn` modulo 20.

    0 takes the row away (gone is true, the rest of it is of no use), 1 empties its text, 2 takes
    `.!?` out of it, 3 repeats the row, 4 makes it the user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    gone = F.col("kind") == 0
    rows = rows.select("conv_id", "turn", role.alias("role"), F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def arcs(row: str | None, state: int) -> Iterator[tuple[str, int, bool, int, str | None]]:
    """(letter, cost, whether it reads the row, state after it, role given) from a state. row: its class, None at the end."""
    if row is not None:
        yield "D", DELETE, True, state, None
        if row != "d":
            more, initial = (CUT_OFF if row.isupper() else 0), row.lower()
            after = state if initial == "e" else STEP.get((state, initial))
            if after is not None:
                yield "K", more, True, after, None
            for r in ROLES:
                if (state, r) in STEP:
                    yield "R", REROLE + more, True, STEP[state, r], r
    for r in ROLES:
        if (state, r) in STEP:
            yield "I", INSERT, False, STEP[state, r], r


def edits(rows: str) -> tuple[int, tuple[tuple[str, str | None], ...]]:
    """Least cost and the least of the cheapest edits as (letter, role given).

    rows: a letter for each turn: d has to be deleted; s u a by its initial, e without one, x any
    other; upper case if it is truncated.
    """
    n, kinds = len(rows), {}
    for k in {*rows, None}:
        kinds[k] = [list(arcs(k, q)) for q in STATES]
    at = lambda i: kinds[rows[i] if i < n else None]
    forward = [[FAR] * 4 for _ in range(n + 1)]
    forward[0][0] = 0
    for i in range(n + 1):
        here = forward[i]
        for _ in STATES:  # insertions stay in the row; after as many rounds as states nothing gets cheaper
            for q in STATES:
                for _, cost, reads, to, _ in at(i)[q]:
                    if not reads:
                        here[to] = min(here[to], here[q] + cost)
        for q in STATES:
            for _, cost, reads, to, _ in at(i)[q]:
                if reads:
                    forward[i + 1][to] = min(forward[i + 1][to], here[q] + cost)
    backward = [[FAR] * 4 for _ in range(n + 1)]
    for q in ENDS:
        backward[n][q] = 0
    for i in range(n, -1, -1):
        here = backward[i]
        for q in STATES:
            for _, cost, reads, to, _ in at(i)[q]:
                if reads:
                    here[q] = min(here[q], cost + backward[i + 1][to])
        for _ in STATES:
            for q in STATES:
                for _, cost, reads, to, _ in at(i)[q]:
                    if not reads:
                        here[q] = min(here[q], cost + here[to])
    total = backward[0][0]
    out, i, frontier = [], 0, {0}
    # Letters say how many rows are read, so that all nodes of the frontier have read as many
    while not (i == n and any(q in ENDS and forward[i][q] == total for q in frontier)):
        tight = [a for q in frontier for a in at(i)[q] if forward[i][q] + a[1] + backward[i + a[2]][a[3]] == total]
        letter = min(a[0] for a in tight)
        chosen = [a for a in tight if a[0] == letter]
        # From a state only one role can be given, and the start is one state: one arc a letter
        out.append((letter, chosen[0][4]))
        frontier = {a[3] for a in chosen}
        i += chosen[0][2]
    return total, tuple(out)


_remembered = lru_cache(1 << 14)(edits)


def repaired(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> tuple:
    """One row of the result, from (turn, role, text) in order."""
    counts, kinds, seen = {"b": 0, "d": 0, "t": 0}, [], set()
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        initial = role[:1]
        letter = initial if initial and initial in "sua" else "x" if initial else "e"
        kinds.append("d" if fault in {"b", "d"} else letter.upper() if fault == "t" else letter)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    word = "".join(kinds)
    cost, chosen = (_remembered if len(word) <= 64 else edits)(word)
    out, i = [], 0
    for letter, role in chosen:
        if letter == "I":
            out.append({"role": ROLES[role], "text": ""})
            continue
        if letter != "D":
            out.append({"role": ROLES[role] if letter == "R" else rows[i][1], "text": rows[i][2]})
        i += 1
    return conv_id, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, "".join(x for x, _ in chosen), out


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text, gone): faults, least cost, edits, the repaired turns.

    Rows that are gone only say that there is a conversation.
    """
    tune(turns.sparkSession)
    kinds = {"conv_id": pa.int64(), "audit": pa.string(), "repaired": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
    names = [c.split(" ")[0] for c in OUT.split(", ")]

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True)

        def found():
            now, own, some = None, [], False
            for conv_id, turn, role, text, gone in rows():
                if some and conv_id != now:
                    yield repaired(now, own)
                    own = []
                now, some = conv_id, True
                if not gone:
                    own.append((turn, role, text))
            if some:
                yield repaired(now, own)

        out, size = [], 0
        for row in found():
            out.append(row)
            size += 200 + sum(len(t["text"]) for t in row[-1])
            if size > 8 << 20:
                yield pack(out)
                out, size = [], 0
        if out:
            yield pack(out)

    def pack(some):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(x, pa.int64())) for c, x in zip(zip(*some, strict=True), names, strict=True)], names=names)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return turns.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, OUT)


def digested(found: DataFrame) -> DataFrame:
    """The repaired turns as a hash of `role:text` lines."""
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.withColumn("repaired_sha256", F.sha2(said.cast("binary"), 256)).drop("repaired")
