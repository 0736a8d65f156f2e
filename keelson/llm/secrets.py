"""Secret scans with a battery of randomness tests (operator 10).

Three fixed patterns give the base spans. Besides, runs of 20 or more characters of
`[A-Za-z0-9+/_=-]` that hold letters and digits are taken as encoded data of the smallest
alphabet that fits (hex, base 32, base 62, base 64, base 64 for URLs); a run is split at an
inner `=` first, and where no alphabet fits, at the characters foreign to base 64 or to base
64 for URLs. Pieces of 20 or more characters (where those of both ways overlap the more
random one, then the rest of the other, at twice the p-value for the choice) are tested for
randomness: chi-squared uniformity over the alphabet, runs about its middle, and serial
correlation. The worst of the three p-values says how random a run looks. How often text that
is not random looks as random is known for each alphabet and length from simulated
identifiers (syllables with digits; fixed seed), and beyond the most random of them from an
exponential tail fitted to the TAIL most random ones, so that no number of runs puts a secret
out of reach by itself. These p-values go through the Benjamini-Hochberg procedure over the
runs of a document at level FALSE_DISCOVERY, weighted by length: half of the weight is dealt
evenly, half in shares that double with every DOUBLING characters (up to LONG), so that the many
short identifiers of a long document do not use up what a long key needs. Weights are 1 on
average and do not depend on the p-values: the share of false discoveries stays below the level.
What passes, and does not overlap a base span, is added as kind `random`.

Lengths are judged by the nearest simulated one below: every eighth to half of an octave, up to
1024; what is longer is judged as 1024, where identifiers look less random the longer they are.

Positions are code points, ends exclusive. Null and empty texts have no spans; an empty table
gives an empty result; very long texts are scanned whole. The result of a row depends on its
text alone; null ids, repeated rows and extra columns make no difference.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import passes, tune
from .kernels import flat, owners

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
KEYWORDS = re.compile(rb"passw|secret|token|api_?key", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
SHORTEST, FALSE_DISCOVERY, SIMULATED, TAIL, DOUBLING, LONG = 20, 0.01, 2000, 100, 4, 128
# Alphabets, in the order in which they are tried
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Syllables of simulated identifiers.
SYLLABLES = ("the", "ing", "and", "ion", "tion", "ent", "for", "ter", "est", "ver", "con", "pro", "com", "per", "sta", "ate", "all", "man", "ser", "ment", "use", "get", "set", "data", "name", "file", "list", "key", "index", "value", "test", "item", "count", "type", "line", "main", "temp", "user", "path")
LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in ALPHABETS["base64"] + "-_="]] = True
_INNER = re.compile(r"[^=]+(?:=+$)?")
_SPLITS = (re.compile("[A-Za-z0-9+/]+=*"), re.compile("[A-Za-z0-9_-]+=*"))
_FREE = re.compile(rb"\0{%d,}" % SHORTEST)
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in ALPHABETS["hex"]]] = True


def stretches(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of this length at least, which do not cross documents."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    start = np.flatnonzero(mask & (~before | edge[:n]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    long = end - start >= least
    return start[long], end[long]


def alphabet(token: str) -> str | None:
    body = token.rstrip("=")
    if len(body) < SHORTEST or not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return None
    return next((name for name, letters in ALPHABETS.items() if not set(body) - set(letters)), None)


def normal_tail(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def battery(symbols: np.ndarray, size: int) -> float:
    """The worst p-value, under randomness, of the three tests on one sequence of symbols."""
    n = len(symbols)
    bins = int(min(size, max(4, n // 4)))
    seen = np.bincount(symbols * bins // size, minlength=bins)
    # How many symbols of the alphabet each bin has, for the expected counts
    wide = np.bincount(np.arange(size) * bins // size, minlength=bins) / size * n
    chi = float(((seen - wide) ** 2 / wide).sum())
    df = bins - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df))
    uniform = 0.5 * erfc(z / sqrt(2))
    high = symbols >= size / 2
    a = int(high.sum())
    b = n - a
    if not a or not b:
        return 0.0
    mean = 2 * a * b / n + 1
    spread = (mean - 1) * (mean - 2) / max(1, n - 1)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    order = normal_tail((runs - mean) / sqrt(spread)) if spread > 0 else 0.0
    x = symbols - symbols.mean()
    power = float((x * x).sum())
    serial = normal_tail(float((x[1:] * x[:-1]).sum()) / power * sqrt(n)) if power else 0.0
    return min(uniform, order, serial)


@lru_cache(maxsize=None)
def simulated(name: str, length: int) -> np.ndarray:
    """Sorted battery values of identifiers of this length, written in this alphabet."""
    letters = ALPHABETS[name]
    rng = np.random.default_rng([length, sorted(ALPHABETS).index(name)])
    out = np.empty(SIMULATED)
    place = {c: i for i, c in enumerate(letters)}
    for i in range(SIMULATED):
        text, style, digits = "", rng.integers(4), rng.random() * 0.4
        while len(text) < length:
            word = SYLLABLES[rng.integers(len(SYLLABLES))]
            text += word.upper() if style == 0 else word if style == 1 else word.capitalize()
            if rng.random() < digits:
                text += str(rng.integers(100))
        text = text[:length]
        text = text.upper() if name in ("HEX", "base32") else text.lower() if name == "hex" else text
        kept = np.array([place[c] for c in text if c in place])
        kept = np.resize(kept, length) if len(kept) else np.zeros(length, np.int64)
        out[i] = battery(kept, len(letters))
    return np.sort(out)


def distance(value: np.ndarray | float) -> np.ndarray:
    """From perfect randomness, on the scale of a normal deviate; its tail falls no slower than an exponential one."""
    return np.sqrt(-2 * np.log(np.clip(value, 1e-300, 1)))


@lru_cache(maxsize=None)
def tail(name: str, length: int) -> tuple[float, float]:
    """Distance within which TAIL simulated identifiers lie, and by how much on average they are nearer than it."""
    near = distance(simulated(name, length)[-TAIL - 1 :])
    return float(near[0]), float(max(1e-6, (near[0] - near[1:]).mean()))


def natural(token: str, name: str) -> float:
    """How often an identifier of about this length looks at least as random."""
    body = token.rstrip("=")
    letters = ALPHABETS[name]
    value = battery(np.array([letters.index(c) for c in body]), len(letters))
    length = max(x for x in LENGTHS if x <= max(LENGTHS[0], len(body)))
    known = simulated(name, length)
    above = len(known) - int(np.searchsorted(known, value))
    p = (above + 1) / (len(known) + 1)
    if above:
        return p
    edge, scale = tail(name, length)
    return min(p, (TAIL + 1) / (len(known) + 1) * float(np.exp((distance(value) - edge) / scale)))


def pieces(token: str) -> list[tuple[int, int, float]]:
    """Start, end and p-value of the parts of a run that fit an alphabet."""
    out: list[tuple[int, int, float]] = []
    taken = bytearray(len(token))
    for m in _INNER.finditer(token):
        name = alphabet(m.group())
        if name:
            out.append((m.start(), m.end(), natural(m.group(), name)))
        elif len(m.group().rstrip("=")) >= SHORTEST:
            parts = [(x, alphabet(x.group())) for split in _SPLITS for x in split.finditer(token, m.start(), m.end())]
            for p, s, e in sorted((natural(x.group(), name), x.start(), x.end()) for x, name in parts if name):
                # What a more random piece has left of this one
                for left in list(_FREE.finditer(taken, s, e)):
                    x, y = left.span()
                    name = alphabet(token[x:y])
                    if name:
                        taken[x:y] = b"\1" * (y - x)
                        out.append((x, y, min(1.0, 2 * (p if (x, y) == (s, e) else natural(token[x:y], name)))))
    return out


def discovered(p: list[float], length: list[int] | None = None, level: float = FALSE_DISCOVERY) -> list[bool]:
    """Benjamini-Hochberg, with weights that grow with length and are 1 on average."""
    value = np.array(p)
    if length is not None:
        share = np.exp2(np.minimum(length, LONG) / DOUBLING)
        value = value / (0.5 + 0.5 * share / share.mean())
    order = np.argsort(value, kind="stable")
    passing = np.flatnonzero(value[order] <= level * np.arange(1, len(p) + 1) / len(p))
    out = np.zeros(len(p), bool)
    if len(passing):
        out[order[: passing[-1] + 1]] = True
    return out.tolist()


def spans(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """Of each text its (start, kind, end) in order, positions in code points."""
    buf, offsets = flat(column)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    data = buf.tobytes()
    bounds = offsets.tolist()
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if KEYWORDS.search(data, a, b):
            out[i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data, a, b) if m.end(2) - m.start(2) >= 6]
        if data.find(b"AKIA", a, b) >= 0:
            out[i] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data, a, b) if m.end() - m.start() >= 20]
    doc = owners(offsets)
    for s, e in zip(*(x.tolist() for x in stretches(_HEX[buf], offsets, 24)), strict=True):
        out[doc[s]].append((s, 2, e))
    found: dict[int, list[tuple[int, int, float]]] = {}
    for s, e in zip(*(x.tolist() for x in stretches(_RUN[buf], offsets, SHORTEST)), strict=True):
        i = int(doc[s])
        for x, y, p in pieces(data[s:e].decode()):
            if all(s + y <= a or s + x >= b for a, _, b in out[i]):
                found.setdefault(i, []).append((s + x, s + y, p))
    for i, runs in found.items():
        keep = discovered([p for _, _, p in runs], [e - s for s, e, _ in runs])
        out[i] += [(s, 3, e) for (s, e, _), k in zip(runs, keep, strict=True) if k]
    for i, own in enumerate(out):
        if own:
            own.sort(key=lambda x: (x[0], x[1], x[2]))
            a = bounds[i]
            before = np.concatenate([[0], np.cumsum((buf[a : bounds[i + 1]] & 0xC0) != 0x80)])
            out[i] = [(int(before[s - a]), kind, int(before[e - a])) for s, kind, e in own]
    return out


def scanned(text: pa.Array) -> pa.Array:
    columns: tuple[list, ...] = ([], [], [], [], [])
    for a, b in passes(text):
        for own in spans(text.slice(a, b - a)):
            named = [(kind, f"{KINDS[kind]}:{s}:{e}") for s, kind, e in own]
            for kind in range(3):
                columns[kind].append(sum(k == kind for k, _ in named))
            columns[3].append(hashlib.sha256(",".join(x for k, x in named if k < 3).encode()).hexdigest())
            columns[4].append(",".join(x for _, x in named))
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def masked(text: pa.Array) -> pa.Array:
    """The text with every span replaced; overlapping spans count as one. Null stays null."""
    out: list[str | None] = []
    for a, b in passes(text):
        part = text.slice(a, b - a)
        for value, own in zip(part.to_pylist(), spans(part), strict=True):
            if own:
                pieces, at = [], 0
                for s, _, e in own:
                    if s >= at:
                        pieces += [value[at:s], "[secret]"]
                    at = max(at, e)
                value = "".join([*pieces, value[at:]])
            out.append(value)
    return pa.array(out, pa.string())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    tune(docs.sparkSession)
    x = docs.select("doc_id", F.arrow_udf(scanned, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")(F.col("text").cast("string")).alias("x"))
    return x.select("doc_id", "x.*")


def redact(text: Column) -> Column:
    return F.arrow_udf(masked, "string")(text.cast("string"))
