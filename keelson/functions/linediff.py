"""Line diffs: the shortest edit between two lists of lines, in the space of a path's front (Myers 1986, with middle snakes)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.shared import workers_find_package

_LINE = re.compile("[^\n]*\n|[^\n]+")


def lines(text: str | None) -> list[str]:
    """With their line feeds: a last line without one is another line than the same with one."""
    return _LINE.findall(text or "")


def changed(a: list, b: list) -> tuple[list[bool], list[bool]]:
    """For each line of either list whether it is not common to both."""
    gone, new = [False] * len(a), [False] * len(b)
    # What the other list lacks cannot be common; the rest is compared as numbers
    number = {x: i for i, x in enumerate({*a} & {*b})}
    at_a, at_b = [i for i, x in enumerate(a) if x in number], [i for i, x in enumerate(b) if x in number]
    for i, x in enumerate(a):
        gone[i] = x not in number
    for i, x in enumerate(b):
        new[i] = x not in number
    x, y = [number[a[i]] for i in at_a], [number[b[i]] for i in at_b]
    todo = [(0, len(x), 0, len(y))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and x[al] == y[bl]:
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and x[ah - 1] == y[bh - 1]:
            ah, bh = ah - 1, bh - 1
        if al == ah or bl == bh:
            for i in range(al, ah):
                gone[at_a[i]] = True
            for i in range(bl, bh):
                new[at_b[i]] = True
            continue
        i, j = middle(x, y, al, ah, bl, bh)
        todo += [(al, i, bl, j), (i, ah, j, bh)]
    return gone, new


def middle(x: list[int], y: list[int], al: int, ah: int, bl: int, bh: int) -> tuple[int, int]:
    """A point on a shortest path between two lists that begin and end differently: where fronts from both ends meet."""
    n, m = ah - al, bh - bl
    delta, odd = n - m, (n - m) % 2
    forward, backward = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            i = forward[k + 1] if k == -d or (k != d and forward.get(k - 1, -1) < forward.get(k + 1, -1)) else forward[k - 1] + 1
            while i < n and 0 <= i - k < m and x[al + i] == y[bl + i - k]:
                i += 1
            forward[k] = i
            if odd and -(d - 1) <= delta - k <= d - 1 and i + backward.get(delta - k, -1) >= n and 0 <= i - k <= m and i <= n:
                return al + i, bl + i - k
        for k in range(-d, d + 1, 2):
            i = backward[k + 1] if k == -d or (k != d and backward.get(k - 1, -1) < backward.get(k + 1, -1)) else backward[k - 1] + 1
            while i < n and 0 <= i - k < m and x[ah - 1 - i] == y[bh - 1 - (i - k)]:
                i += 1
            backward[k] = i
            if not odd and -d <= delta - k <= d and i + forward.get(delta - k, -1) >= n and 0 <= i - k <= m and i <= n:
                return ah - i, bh - (i - k)
    raise AssertionError("paths do not meet")


def patch(before: str | None, after: str | None) -> str:
    """Hunks without context: what goes, then what comes, in order."""
    a, b = lines(before), lines(after)
    gone, new = changed(a, b)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if not (i < len(a) and gone[i]) and not (j < len(b) and new[j]):
            i, j = i + 1, j + 1
            continue
        p, q = i, j
        while i < len(a) and gone[i]:
            i += 1
        while j < len(b) and new[j]:
            j += 1
        out.append(f"@@ -{p + 1 if i > p else p},{i - p} +{q + 1 if j > q else q},{j - q} @@\n")
        for mark, some in (("-", a[p:i]), ("+", b[q:j])):
            out += [mark + x if x.endswith("\n") else f"{mark}{x}\n\\ No newline at end of file\n" for x in some]
    return "".join(out)


def patched(before: Column, after: Column) -> Column:
    """patch as a column."""
    workers_find_package()

    @F.arrow_udf("string")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([patch(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    return run(before, after)
