"""Substring dedup by difference-cover anchors (operator 9).

The residues {0, 1, 3} modulo 7 are a perfect difference cover: for any two positions there
is a shift below 7 that brings both onto a residue of the cover. So two equal runs of 13
words, wherever they begin, share an anchor: seven words that begin at a cover position in
both documents. Only anchors are hashed and sent (three of seven positions); anchors that
two documents share are then extended by the six words on either side (see anchored). Windows
are equal by 128 bits: two independent hashes of their words.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A null text has no words; a null doc_id neither
removes nor loses words; rows that repeat a doc_id are one document's: none of them is earlier
than the other, and each loses what documents of smaller ids hold. Texts of fewer than 13
words stay; very long ones are worked through whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchored import Scan, Scheme, covered, documents, removal, repeated
from .kernels import U64, Rolling, mix, owners, word_hashes, words

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class CoverAnchors(Scheme):
    def __init__(self, width: int = WINDOW):
        self.width = width
        self.anchor = width - PERIOD + 1

    def scan(self, buf: np.ndarray, offsets: np.ndarray) -> Scan:
        starts, ends, first = words(buf, offsets)
        hashes = word_hashes(buf, starts, ends)
        rolled, other = Rolling(hashes), Rolling(mix(hashes + U64(0x632BE59BD9B4E019)))
        width = self.width
        doc = owners(first)
        at = np.arange(len(starts))
        local = at - first[:-1][doc]
        room = first[1:][doc] - at
        on = np.isin(local % PERIOD, COVER) & (room >= self.anchor)
        at, doc, local = at[on], doc[on], local[on]
        low = np.maximum(at - PERIOD + 1, first[:-1][doc])
        high = np.minimum(at, first[1:][doc] - width)
        fits = low <= high
        at, doc, low, high = at[fits], doc[fits], low[fits], high[fits]
        key = rolled.of(at, at + self.anchor)
        context = lambda i: mix(other.of(low[i], high[i] + width) + ((at - low) * 16 + high - low)[i].astype(U64))
        return Scan(first[:-1], doc, key, context, low, high, lambda p: rolled.of(p, p + width), lambda p: other.of(p, p + width))

    def windows(self, buf: np.ndarray, offsets: np.ndarray):
        starts, ends, first = words(buf, offsets)
        rolled = Rolling(word_hashes(buf, starts, ends))
        return first[:-1], lambda p: rolled.of(p, p + self.width)


def kept(scheme: CoverAnchors):
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for ids, known, buf, offsets, marks in documents(batches, True):
            _, _, first = words(buf, offsets)
            n = int(first[-1])
            gone = covered(repeated(scheme, buf, offsets, marks), scheme.width, n) if marks else np.zeros(n, bool)
            before = np.concatenate([[0], np.cumsum(gone)])
            removed = before[first[1:]] - before[first[:-1]]
            digest = []
            for i, (a, b, r) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True)):
                own = buf[a:b].tobytes().split()
                if r:
                    own = [w for w, g in zip(own, gone[first[i] : first[i + 1]].tolist(), strict=True) if not g]
                digest.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(np.diff(first)), pa.array(removed), pa.array(digest, pa.string())], schema=kind)

    return run


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: words, words removed, and the digest of the words that stay, joined by one space.

    A word goes if a window of width words that covers it also starts in a document with a smaller doc_id.
    """
    scheme = CoverAnchors(width)
    return removal(docs, scheme, kept(scheme), SCHEMA)
