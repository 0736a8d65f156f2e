"""Token counts by the whole-token shortcut (operator 7).

The text of a piece model is cut where no piece can reach: before a run of the space mark
that follows other characters (no piece of the vocabulary has the mark inside), and around
characters that no piece holds at all (line feeds). Counts of the parts then add up. Which
strings of the vocabulary encode alone as one token is proven with the library before any
text is read; words among them count one each. What is left is merged by the library, once
for each different part while it is remembered; at most REMEMBERED bytes of parts are.

A null or empty text has no tokens; very long ones are counted whole. The result of a row
depends on its text alone: null and repeated ids have a row each. Extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

MARK = "▁"
#: Bytes of remembered parts, with what they cost beside their letters; beyond it they are forgotten and merged anew.
REMEMBERED = 128 << 20
LIMIT = 4096
_counters: dict[str, Counter] = {}


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces) and self._plain()
        self.line = not any("\n" in p for p in pieces)
        starts = [p[1:] for p in pieces if p.startswith(MARK) and MARK not in p[1:]]
        encoded = self.model.encode(starts, num_threads=1)
        self.whole = {s: 1 for s, ids in zip(starts, encoded, strict=True) if len(ids) == 1}
        self.words: dict[str, int] = dict(self.whole)
        self.tails: dict[str, int] = {}
        self.held = 0
        self.feed = len(self.model.encode("\n")) - 1 if self.line else 0

    def _plain(self) -> bool:
        """Whether the model takes texts as they are, but for one mark before them."""
        return self.model.encode("x  y\tZ", out_type=str)[0].startswith(MARK) and self.model.decode(self.model.encode("x  y\tZ é ﬁ")) == "x  y\tZ é ﬁ"

    def learn(self, words: set[str], tails: set[str]) -> None:
        """Counts of the parts that are not remembered; where there is no room, all others are forgotten."""
        new = words.difference(self.words), tails.difference(self.tails)
        more = sum(2 * len(x.encode()) + 256 for part in new for x in part)
        if self.held and self.held + more > REMEMBERED:
            self.words, self.tails, self.held = dict(self.whole), {}, 0
            new = words.difference(self.words), tails
            more = sum(2 * len(x.encode()) + 256 for part in new for x in part)
        self.held += more
        if new[0]:
            self.learn_plain(new[0])
        if new[1]:
            self.learn_tails(new[1])

    def learn_plain(self, words: set[str]) -> None:
        """Counts of parts that stand behind one mark."""
        order = list(words)
        for w, ids in zip(order, self.model.encode(order, num_threads=1), strict=True):
            self.words[w] = len(ids) if w else 1

    def learn_tails(self, tails: set[str]) -> None:
        """Counts of parts that follow a line feed: encoded behind one, which costs the mark and itself."""
        order = list(tails)
        for x, ids in zip(order, self.model.encode(["\n" + x for x in order], num_threads=1), strict=True):
            self.tails[x] = len(ids) - 1 - self.feed

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.model.encode(text))
        if text[0] == " " or "  " in text or MARK in text:
            total = 0
            words = []
            for part in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)):
                if part.startswith(MARK * 2):
                    total += len(self.model.encode(part[1:]))
                else:
                    words.append(part[1:])
        else:
            total, words = 0, text.split(" ")
        tails = []
        if self.line and "\n" in text:
            lines, words = words, []
            for w in lines:
                if "\n" in w:
                    w, *more = w.split("\n")
                    tails += more
                words.append(w)
            total += self.feed * len(tails)
        self.learn(set(words), set(tails))
        return total + sum(map(self.words.__getitem__, words)) + sum(map(self.tails.__getitem__, tails))


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def counted(path: str):
    @F.arrow_udf("n_bytes long, n_tokens long")
    def run(text: pa.Array) -> pa.Array:
        c = counter(path)
        n = np.fromiter((c.count(t) for t in text.fill_null("").to_pylist()), np.int64, len(text))
        return pa.StructArray.from_arrays([pc.fill_null(pc.binary_length(text.cast(pa.large_binary())), 0).cast(pa.int64()), pa.array(n)], names=["n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens as the model's library gives them, and whether they exceed the limit."""
    tune(docs.sparkSession)
    x = docs.select("doc_id", counted(path)(F.col("text").cast("string")).alias("x"))
    return x.select("doc_id", "x.n_bytes", "x.n_tokens", (F.col("x.n_tokens") > limit).alias("over_limit"))
