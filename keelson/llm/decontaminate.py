"""Benchmark decontamination with SimHash windows (operator 1).

Texts are cut to words (lower case; runs of ASCII letters, digits and bytes above 127). A
document is compared with an item in windows of the item's number of words. Each window
has a SimHash of BITS bits over its five-word shingles, weighted by how often they occur. A
multi-index holds the items of each length: fingerprints within RADIUS bits agree up to
RADIUS // BLOCKS bits in one of BLOCKS blocks, so that looking up each block of a window among
the near values of item blocks misses none within the radius. Candidates are verified with
the exact similarity of weighted shingles (sum of least over sum of largest weights), which
has to be THRESHOLD or more. Windows without a single shingle of the benchmark have similarity
0 with all items; they are not fingerprinted. An item of fewer than five words is a single
shingle of that many words, wherever it stands in a text.

Items go to all workers, at most ITEMS and ITEM_BYTES at a time; a larger benchmark is worked
through in such slices, one pass over the texts for each, whose result is written before the
next slice is read: neither driver nor workers hold more than two slices. Workers build the
index of near block values themselves.

Null and empty items and texts match nothing, an empty table of either kind gives no rows. A
null doc_id is reported with its matches; repeated rows are reported each. Very long texts are
worked through whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import passes, stored, tune
from .kernels import U64, Rolling, flat, mix, owners, word_hashes, words

BITS, BLOCKS, RADIUS = 128, 8, 31
THRESHOLD, WIDTH = 0.75, 5
ITEMS, ITEM_BYTES = 1000, 8 << 20
#: Window positions that are fingerprinted at a time.
ZONE = 1 << 14
_PLAIN = np.full(256, 32, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _PLAIN[_c] = _c
_PLAIN[128:] = np.arange(128, 256)


def word_sequence(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text."""
    buf, offsets = flat(pc.utf8_lower(text.fill_null("")))
    buf = _PLAIN[buf]
    starts, ends, first = words(buf, offsets)
    return word_hashes(buf, starts, ends), first


def planes(shingle: np.ndarray) -> np.ndarray:
    """A row of BITS signs for each shingle."""
    both = np.stack([mix(shingle + U64(1)), mix(shingle + U64(2))], 1).copy()
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint16)


_built: dict[str, dict] = {}


class Items:
    """The benchmark's items of one slice, by length, with the index of each length."""

    def __init__(self, ids: list[int], texts: list[str]):
        word, first = word_sequence(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        self.size = np.diff(first)
        self.shingles, self.weights, self.prints = [], [], []
        for i in range(len(ids)):
            s = shingles_of(word[first[i] : first[i + 1]])
            v, n = np.unique(s, return_counts=True)
            self.shingles.append(v)
            self.weights.append(n)
            self.prints.append(fingerprint(planes(v).T.dot(n)[None, :])[0] if len(v) else np.zeros(BITS // 16, np.uint16))
        self.name = hashlib.sha256(self.ids.tobytes() + word.tobytes() + first.tobytes()).hexdigest()
        self.lengths = np.unique(self.size[self.size > 0]).tolist()
        # The shingles of items, by their number of words
        self.all = {w: np.unique(np.concatenate([self.shingles[i] for i in np.flatnonzero(np.minimum(self.size, WIDTH) == w)])) for w in sorted({min(n, WIDTH) for n in self.lengths})}

    @property
    def index(self) -> dict:
        """Of each length its items, their fingerprints and blocks; built once in a worker, for the slice it works on."""
        if self.name not in _built:
            _built.clear()
            near = np.array([x for x in range(1 << 16) if x.bit_count() <= RADIUS // BLOCKS], np.uint16)
            index = {}
            for n in self.lengths:
                own = np.flatnonzero(self.size == n)
                prints = np.array([self.prints[i] for i in own])
                blocks = []
                for b in range(BLOCKS):
                    value = (prints[:, b][:, None] ^ near[None, :]).ravel()
                    order = np.argsort(value, kind="stable")
                    blocks.append((value[order], np.repeat(np.arange(len(own), dtype=np.int32), len(near))[order]))
                index[n] = (own, prints, blocks)
            _built[self.name] = index
        return _built[self.name]

    def candidates(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) whose fingerprints are within the radius."""
        own, known, blocks = self.index[n]
        found = []
        for b, (value, item) in enumerate(blocks):
            low, high = np.searchsorted(value, prints[:, b]), np.searchsorted(value, prints[:, b], "right")
            count = high - low
            window = np.repeat(np.arange(len(prints)), count)
            at = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            found.append(window * len(own) + item[at])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(own), pair % len(own)
        apart = np.bitwise_count(prints[window] ^ known[item]).sum(1)
        return window[apart <= RADIUS], own[item[apart <= RADIUS]]

    def similarity(self, item: int, window: np.ndarray) -> float:
        v, n = np.unique(window, return_counts=True)
        known, weight = self.shingles[item], self.weights[item]
        at = np.searchsorted(known, v)
        at[at == len(known)] = 0
        both = known[at] == v
        common = int(np.minimum(n[both], weight[at[both]]).sum())
        return common / (int(n.sum()) + int(weight.sum()) - common)


def shingles_of(word: np.ndarray) -> np.ndarray:
    n = len(word)
    if not n:
        return np.zeros(0, U64)
    at = np.arange(max(1, n - WIDTH + 1))
    return Rolling(word).of(at, np.minimum(at + WIDTH, n))


def matches(items: Items, text: pa.Array) -> list[list[tuple[int, float, int, int]]]:
    """Of each text (item_id, similarity, first word, words) for every item that it holds, its best window."""
    word, first = word_sequence(text)
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(first) - 1)]
    if len(word) and items.lengths:
        doc = owners(first)
        at = np.arange(len(word))
        last = first[1:][doc]
        rolled = Rolling(word)
        for width, known in items.all.items():
            # Of a text of fewer words the only shingle starts at its first word
            real = (at + width <= last) | ((np.diff(first)[doc] < width) & (at == first[:-1][doc]))
            shingle = rolled.of(at, np.minimum(at + width, last))
            place = np.searchsorted(known, shingle)
            place[place == len(known)] = 0
            hit = np.flatnonzero(real & (known[place] == shingle))
            for n in items.lengths if len(hit) else ():
                if min(n, WIDTH) == width:
                    for window in starts(hit, n, width, first, doc):
                        compare(items, n, width, window, first, doc, shingle, best)
    return [[(int(items.ids[i]), *x) for i, x in sorted(own.items())] for own in best]


def starts(hit: np.ndarray, n: int, width: int, first: np.ndarray, doc: np.ndarray) -> Iterator[np.ndarray]:
    """Starts of windows of n words that hold a hit, in stretches. A shorter text has one window, itself."""
    span = n - width + 1
    low = np.maximum(hit - span + 1, first[:-1][doc[hit]])
    high = np.maximum(np.minimum(hit, first[1:][doc[hit]] - n), first[:-1][doc[hit]])
    low = np.minimum(low, high)
    # Hits are in order, and so are their ranges: what the one before covers is left out
    reach = np.maximum.accumulate(high)
    low[1:] = np.maximum(low[1:], reach[:-1] + 1)
    for x in range(0, len(low), 256):
        a, b = low[x : x + 256], high[x : x + 256]
        size = np.maximum(b - a + 1, 0)
        total = int(size.sum())
        if total:
            out = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(total)
            for y in range(0, total, ZONE):
                yield out[y : y + ZONE]


def compare(items: Items, n: int, width: int, window: np.ndarray, first: np.ndarray, doc: np.ndarray, shingle: np.ndarray, best: list) -> None:
    end = np.minimum(window + n, first[1:][doc[window]])
    stop = np.maximum(end - width + 1, window + 1)
    # Window starts may lie far apart: sums run over the shingles that the windows touch
    need = np.zeros(int(stop.max() - window[0]) + 1, np.int32)
    np.add.at(need, window - window[0], 1)
    np.add.at(need, stop - window[0], -1)
    used = np.flatnonzero(np.cumsum(need) > 0) + window[0]
    for x in range(0, len(window), 2048):
        w, s = window[x : x + 2048], stop[x : x + 2048]
        local = used[np.searchsorted(used, w[0]) : np.searchsorted(used, s.max())]
        sums = np.zeros((len(local) + 1, BITS), np.int32)
        np.cumsum(planes(shingle[local]), axis=0, out=sums[1:])
        prints = fingerprint(sums[np.searchsorted(local, s)] - sums[np.searchsorted(local, w)])
        for k, i in zip(*items.candidates(n, prints), strict=True):
            k, i = int(k), int(i)
            value = items.similarity(i, shingle[w[k] : s[k]])
            if value >= THRESHOLD:
                d = int(doc[w[k]])
                found = (value, int(w[k] - first[d]), int(end[x + k] - w[k]))
                if i not in best[d] or (found[0], -found[1]) > (best[d][i][0], -best[d][i][1]):
                    best[d][i] = found


def sliced(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in slices that are safe to send to all workers."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").orderBy("item_id", "text")
    for i, text in rows.toLocalIterator():
        if ids and (len(ids) >= ITEMS or size + len(text) > ITEM_BYTES):
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += len(text)
    if ids:
        yield Items(ids, texts)


KIND = "array<struct<item_id:long,similarity:double,start_word:long,n_words:long>>"


def found_in(items: Items):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())]))
    names = ("item_id", "similarity", "start_word", "n_words")

    @F.arrow_udf(KIND)
    def run(text: pa.Array) -> pa.Array:
        out = []
        for a, b in passes(text):
            out += [[dict(zip(names, m, strict=True)) for m in own] for own in matches(items, text.slice(a, b - a))]
        return pa.array(out, kind)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: similarity and place of the best window. Clean documents have none."""
    spark = docs.sparkSession
    tune(spark)
    found = None
    for items, only in _slices(benchmark):
        x = docs.select("doc_id", F.explode(found_in(items)(F.col("text").cast("string"))).alias("x"))
        rows = x.select("doc_id", "x.item_id", "x.similarity", "x.start_word", "x.n_words")
        rows = rows if only else stored(rows, "found")
        found = rows if found is None else found.unionByName(rows)
    return docs.select("doc_id", F.explode(F.array().cast(KIND)).alias("x")).select("doc_id", "x.*") if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    tune(docs.sparkSession)
    for items, only in _slices(benchmark):
        docs = docs.where(F.size(found_in(items)(F.col("text").cast("string"))) == 0)
        docs = docs if only else stored(docs, "clean")
    return docs


def _slices(benchmark: DataFrame) -> Iterator[tuple[Items, bool]]:
    """Slices, and whether there is but one."""
    last, one = None, True
    for items in sliced(benchmark):
        if last is not None:
            one = False
            yield last, one
        last = items
    if last is not None:
        yield last, one
