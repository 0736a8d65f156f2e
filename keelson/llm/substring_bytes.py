"""Suffix-array dedup by prefix-free parsing (operator 5).

Parse: a rolling hash over 24 bytes triggers a phrase wherever it is least among the 27 places
that a 50-byte window has (a trigger by residue would leave phrases of any length, and windows
without one). Neighbouring phrases overlap by 49 bytes, so that each 50-byte string of a text
lies in exactly one of them, and no phrase has a suffix of 50 bytes that is another's prefix
without being it. A text is the sequence of its phrases.

Dictionary: distinct phrases, each with the smallest doc_id that has it. As phrases overlap by
49 bytes, the order of two suffixes of the parse to a depth of 50 bytes is that of their first
phrases alone: all suffixes that begin in equal phrases are equal to that depth, and of those
the first by doc_id is known without looking into the phrase. Highly repetitive text ends here.

Suffix array of the dictionary: suffixes of 50 bytes and more of distinct phrases are put in
lexicographic order to depth 50 by prefix doubling (8, 16, 32, 50 bytes); those next to each
other with a common prefix of 50 bytes are one class, whose first document is the smallest
doc_id among its phrases. Phrases that share 50 bytes share their trigger: the array is built
trigger by trigger, some at a time. Both orders together give for each suffix of the corpus the
first document of its class. Triggers with more than LIMIT phrases, or FEW in 8 MB of text, are
not gathered in one place: their windows meet one by one under 128-bit names.

Nulls: a null text is empty; a null doc_id neither removes nor loses bytes. Texts under 50
bytes stay; very long ones are worked through whole. Rows that repeat a doc_id are one
document's: none of them is earlier than the other, and each loses what documents of smaller
ids hold. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchored import Scan, Scheme, covered, documents, removal, repeated, spans
from .common import runs
from .kernels import U64, Rolling, byte_symbols, mix, word_hashes

WINDOW, TRIGGER = 50, 24
#: Distinct phrases of one trigger in 8 MB of text, and in all, that are sorted together.
FEW, LIMIT = 8, 1024
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def ordered(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of values, and their ranks in it; equal ones share a rank."""
    order = np.argsort(value)
    rank = np.zeros(len(order), U64)
    ascending = value[order]
    rank[order[1:]] = np.cumsum(ascending[1:] != ascending[:-1]).astype(U64)
    return order, rank


def suffix_array(text: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of phrases that lie back to back: suffixes of depth bytes and more, in lexicographic order to that depth, and where classes of equals begin."""
    start = np.cumsum(size) - size
    have = min(8, depth)
    at = spans(start, start + size - have)
    value = np.ndarray((len(text),), ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), 0, (1,)).astype(U64)[at] >> U64(8 * (8 - have))
    order, rank = ordered(value)
    while have < depth:
        step = min(have, depth - have)
        ranks = np.zeros(len(text), U64)
        ranks[at] = rank
        have += step
        at = spans(start, start + size - have)
        order, rank = ordered(ranks[at] << U64(32) | ranks[at + step])
    return at[order], runs(rank[order])


class Phrases(Scheme):
    few, limit = FEW, LIMIT

    def __init__(self, width: int = WINDOW, trigger: int = TRIGGER):
        self.width, self.trigger = width, trigger

    def scan(self, buf: np.ndarray, offsets: np.ndarray) -> Scan:
        n, width = len(buf), self.width
        rolled = Rolling(byte_symbols(buf))
        window = lambda p: rolled.of(p, p + width)
        second = lambda p: word_hashes(buf, p, p + width, width)
        if n < width:
            none = np.zeros(0, np.int64)
            return Scan(offsets[:-1], none, none.astype(U64), lambda i: i.astype(U64), none, none, window, second)
        gram = rolled.every(self.trigger)
        bits = U64(max(1, n.bit_length()))
        least = ((gram >> bits) << bits) | np.arange(len(gram), dtype=U64)
        span, reach = width - self.trigger + 1, 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        place = (least & U64((1 << int(bits)) - 1)).astype(np.int64)  # by window start
        size = np.diff(offsets)
        inside = np.repeat(offsets[1:], size)[: len(place)] - np.arange(len(place)) >= width
        start = np.flatnonzero(inside)
        place = place[start]
        begin = runs(place, start - np.arange(len(start)))
        last = np.append(begin[1:], len(place)) - 1 if len(begin) else begin
        at, low, high = place[begin], start[begin], start[last]
        doc = np.searchsorted(offsets, low, "right") - 1
        context = lambda i: mix(word_hashes(buf, low[i], high[i] + width, 2 * width) + ((at - low) * 64 + high - low)[i].astype(U64))
        return Scan(offsets[:-1], doc, gram[at], context, low, high, window, second)

    def windows(self, buf: np.ndarray, offsets: np.ndarray):
        rolled = Rolling(byte_symbols(buf))
        return offsets[:-1], lambda p: rolled.of(p, p + self.width)

    def phrases(self, text: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, begin = suffix_array(text, size, self.width)
        own = ids[np.searchsorted(np.cumsum(size), at, "right")]
        least = np.repeat(np.minimum.reduceat(own, begin), np.diff(begin, append=len(at)))
        again = own > least
        return own[again], Rolling(byte_symbols(text)).of(at[again], at[again] + self.width)


def kept(scheme: Phrases):
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for ids, known, buf, offsets, marks in documents(batches, True):
            size = np.diff(offsets)
            if marks:
                gone = covered(repeated(scheme, buf, offsets, marks), scheme.width, len(buf))
            else:
                gone = np.zeros(len(buf), bool)
            before = np.concatenate([[0], np.cumsum(gone)])
            removed = before[offsets[1:]] - before[offsets[:-1]]
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            edges = offsets[:-1][offsets[:-1] < len(buf)]
            opens[edges] = gone[edges]
            opened = np.concatenate([[0], np.cumsum(opens)])
            digest = []
            for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True):
                digest.append(hashlib.sha256(buf[a:b][~gone[a:b]] if r else buf[a:b]).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(size), pa.array(removed), pa.array(opened[offsets[1:]] - opened[offsets[:-1]]), pa.array(digest, pa.string())], schema=kind)

    return run


def remove_repeats(docs: DataFrame, width: int = WINDOW, trigger: int = TRIGGER) -> DataFrame:
    """Per document: bytes, bytes and runs removed, and the digest of what stays.

    A byte goes if a string of width bytes that covers it also starts in a document with a smaller doc_id.
    """
    scheme = Phrases(width, trigger)
    return removal(docs, scheme, kept(scheme), SCHEMA)
