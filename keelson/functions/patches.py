"""Added lines of unified patches as ranges, a batch at a time."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line of a patch << 32 | line.
LINE = (1 << 32) - 1


def added(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, line) of all added lines of some patches; patch t is data[cuts[t] : cuts[t + 1]].

    The rules of operators.diff.added_lines: text before the first `@@` is skipped, `@@` sets the
    number, `+` lines are added and advance it, `-`, `\\` and `+++` lines do not, others do.
    """
    nothing = np.zeros(0, np.int64)
    after = np.flatnonzero(data == 10) + 1
    begin = np.sort(np.concatenate([cuts[:-1][np.diff(cuts) > 0], after[~np.isin(after, cuts)]]))
    if not len(begin):
        return nothing, nothing
    text = np.searchsorted(cuts, begin, "right") - 1
    room, padded = cuts[text + 1] - begin, np.concatenate([data, np.zeros(3, np.uint8)])
    b = [np.where(room > k, padded[begin + k], 0) for k in range(3)]
    head = (b[0] == 64) & (b[1] == 64)
    where = np.flatnonzero(head)
    if not len(where):
        return nothing, nothing
    start = _first(padded, begin[where])
    of = np.cumsum(head) - 1
    inside = (of >= 0) & (text[where[of]] == text)
    counts = inside & ~head & ~((b[0] == 43) & (b[1] == 43) & (b[2] == 43)) & (b[0] != 45) & (b[0] != 92)
    so_far = np.cumsum(counts)
    plus = np.flatnonzero(counts & (b[0] == 43))
    return text[plus], start[of[plus]] + so_far[plus] - so_far[where[of[plus]]] - 1


def _first(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The number of each header: the digits after the first plus sign of its line, or 1, also where they are no int. data ends with a zero."""
    signs = np.append(np.flatnonzero((data == 43) | (data == 10)), len(data) - 1)
    at = signs[np.searchsorted(signs, begin)]
    at = np.where(data[at] == 43, at + 1, len(data) - 1)
    number, digits, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.ones(len(at), bool)
    while True:
        digit = data[at].astype(np.int64) - 48
        open_ &= (digit >= 0) & (digit <= 9)
        if not open_.any():
            return np.where((digits == 0) | (number >= 1 << 31), 1, number)
        # Beyond an int it stays there, whatever follows
        number = np.where(open_, np.minimum(number * 10 + digit, 1 << 31), number)
        digits, at = digits + open_, at + open_


def runs(patches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of added lines: where those of each patch begin, and the first and last line of each, in order, as patch << 32 | line."""
    texts = pc.fill_null(patches, "").cast(pa.large_string())
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    if (data == 13).any():
        lines = [re.sub(b"\r\n|\r", b"\n", x.encode()) for x in texts.to_pylist()]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
        data = np.frombuffer(b"".join(lines), np.uint8)
    text, line = added(data, cuts)
    key = text << 32 | line
    if (np.diff(key) <= 0).any():
        key = np.unique(key)
    new = np.flatnonzero(np.append(True, np.diff(key) != 1)[: len(key)])
    first, last = key[new], key[np.append(new[1:], len(key)) - 1] if len(key) else key
    return np.searchsorted(first, np.arange(len(texts) + 1) << 32), first, last


def ranges(patches: pa.Array) -> list[tuple[list[int], list[int]]]:
    """For each patch the first and the last line of each run of added lines, in order."""
    at, first, last = runs(patches)
    first, last = (first & LINE).tolist(), (last & LINE).tolist()
    return [(first[a:b], last[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def holds(starts: Column, stops: Column, line: Column) -> Column:
    """Whether a line is in one of some ranges in order: a binary search, in proportion to the logarithm of their number."""
    last = F.size(starts) - 1
    halves = F.sequence(F.floor(F.log2(F.greatest(last, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        further = F.least(at + F.pow(F.lit(2), k).cast("int"), last)
        return F.when(F.get(starts, further) <= line, further).otherwise(at)

    at = F.aggregate(halves, F.lit(0), step)
    return F.coalesce((F.get(starts, at) <= line) & (F.get(stops, at) >= line), F.lit(False))
