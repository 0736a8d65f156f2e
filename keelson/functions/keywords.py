"""All keywords in one pass over the bytes of a batch of texts.

Two tables of byte pairs (the first and second byte of some keyword, the second and third) leave
few places of a text over; these are compared with the keywords that begin like them. Letters A-Z
of either case are the same. Cost is that of the text, whatever the number of keywords.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import workers_find_package
from .patches import LINE, runs

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are looked at together.
PASS = 4 << 20


def folded(keyword: str) -> bytes:
    return bytes(_LOWER[np.frombuffer(keyword.encode(), np.uint8)])


class Matcher:
    def __init__(self, keywords: Iterable[str]):
        self.words = [folded(k) for k in keywords]
        self.longest = max(map(len, self.words), default=0)
        if any(not w for w in self.words):
            raise ValueError("an empty keyword")
        self.first, self.second = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.heads: dict[int, list[int]] = defaultdict(list)
        self.short = [i for i, w in enumerate(self.words) if len(w) < 3]
        for i, w in enumerate(self.words):
            if len(w) >= 3:
                self.first[w[0] | w[1] << 8] = self.second[w[1] | w[2] << 8] = True
                self.heads[w[0] | w[1] << 8 | w[2] << 16].append(i)

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, keyword) of all occurrences in lower-cased bytes, overlapping ones too, in order."""
        n = len(data)
        low = np.concatenate([data, np.zeros(self.longest + 3, np.uint8)])
        found: list[tuple[np.ndarray, int]] = []
        for i in self.short:
            at = np.flatnonzero(low[:n] == self.words[i][0])
            found.append((self._rest(low, at, i, 1), i))
        if self.heads and n:
            pair = low[: n + 1].astype(np.uint16)
            pair |= low[1 : n + 2].astype(np.uint16) << np.uint16(8)
            at = np.flatnonzero(self.first[pair[:-1]] & self.second[pair[1:]])
            head = pair[at] | low[at + 2].astype(np.uint32) << np.uint32(16)
            order = np.argsort(head, kind="stable")
            head, at = head[order], at[order]
            for h, words in self.heads.items():
                own = at[np.searchsorted(head, h) : np.searchsorted(head, h, "right")]
                if len(own):
                    found += [(self._rest(low, own, i, 3), i) for i in words]
        place = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
        word = np.concatenate([np.full(len(p), i) for p, i in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(place, kind="stable")
        return place[order], word[order]

    def _rest(self, low: np.ndarray, at: np.ndarray, i: int, known: int) -> np.ndarray:
        for j in range(known, len(self.words[i])):
            at = at[low[at + j] == self.words[i][j]]
        return at

    def hits(self, texts: pa.Array) -> Iterable[Hits]:
        """The occurrences within each text of a column, some MB at a time."""
        texts = texts.cast(pa.large_string())
        buffers = texts.buffers()
        ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        every = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        size = np.fromiter((len(w) for w in self.words), np.int64, len(self.words))
        begin = 0
        while begin < len(texts):
            stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + PASS, "right")) - 1)
            base, cuts = ends[begin], ends[begin : stop + 1] - ends[begin]
            data = every[base : ends[stop]]
            low = _LOWER[data]
            place, word = self.places(low)
            text = np.searchsorted(cuts, place, "right") - 1
            # What begins in one text and ends in the next is no occurrence
            inside = place + size[word] <= cuts[text + 1] if len(place) else np.zeros(0, bool)
            yield Hits(begin, data, low, cuts, place[inside], word[inside], text[inside])
            begin = stop


@dataclass
class Hits:
    """Texts begin.. of a column: their bytes, as they are and lower-cased, where each starts, and (place, word, text) of each occurrence."""

    begin: int
    data: np.ndarray
    low: np.ndarray
    cuts: np.ndarray
    place: np.ndarray
    word: np.ndarray
    text: np.ndarray


def present(content: Column, keywords: list[str]) -> Column:
    """The keywords that a text holds, in order; null for null."""
    workers_find_package()
    matcher = Matcher(keywords)

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        out: list[list[str] | None] = [[] if ok else None for ok in column.is_valid().to_pylist()]
        for h in matcher.hits(column):
            for t, w in np.unique(np.stack([h.text, h.word], axis=1), axis=0).tolist():
                out[h.begin + t].append(keywords[w])
        return pa.array([x and sorted(x) for x in out], pa.list_(pa.string()))

    return run(content)


#: A piece of a text for one detector: characters and line feeds before it; whether all of its lines count, and if not a byte for each line of the text, 1 where it does; its own text.
PIECE = pa.schema([("which", pa.int32()), ("offset", pa.int32()), ("line", pa.int32()), ("sure", pa.bool_()), ("lines", pa.binary()), ("text", pa.string())])
#: The same as a schema of Spark.
PIECE_COLUMNS = "which int, offset int, line int, sure boolean, lines binary, text string"


@dataclass(frozen=True)
class Rule:
    """When a detector looks at a text: file name extensions and keywords, if any; one_line: no match of it leaves a line."""

    extensions: tuple[str, ...]
    keywords: tuple[str, ...]
    one_line: bool


class Cutter:
    """What detectors have to look at: the lines that hold a keyword of theirs, where their matches stay within a line, else the whole text."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        words = sorted({folded(k) for r in rules for k in r.keywords})
        self.matcher = Matcher([w.decode() for w in words])
        of_word = [[d for d, r in enumerate(rules) if w in {folded(k) for k in r.keywords}] for w in words]
        self.many = np.array([len(x) for x in of_word], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.of_word = np.array([d for x in of_word for d in x], np.int64)
        self.one_line = np.array([r.one_line for r in rules], bool)
        self.always = [d for d, r in enumerate(rules) if not r.keywords]

    def cut(self, texts: pa.Array, extensions: pa.Array, added: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> Iterable[tuple[np.ndarray, pa.RecordBatch]]:
        """Some MB at a time: the numbers of texts, and the pieces of them. added: runs of lines; other lines do not count, and texts without any give nothing."""
        coded = extensions.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        ext = coded.indices.fill_null(len(kinds)).to_numpy(zero_copy_only=False)
        fits = np.array([[not r.extensions or e in r.extensions for r in self.rules] for e in [*kinds, None]], bool).reshape(len(kinds) + 1, len(self.rules))
        live = np.ones(len(texts), bool) if added is None else np.diff(added[0]) > 0
        given = live & (pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0)
        small = lambda x: pa.array(x).cast(pa.int32())
        for h in self.matcher.hits(texts):
            text, which, offset, line, sure, (many, lines), (size, data) = self._pass(h, ext, fits, live, given, added)
            if len(text):
                rows = pa.Array.from_buffers(pa.binary(), len(text), [None, _ends(many), pa.py_buffer(lines)])
                strings = pa.Array.from_buffers(pa.string(), len(text), [None, _ends(size), pa.py_buffer(data)])
                yield text, pa.RecordBatch.from_arrays([small(which), small(offset), small(line), pa.array(sure), rows, strings], schema=PIECE)

    def _pass(self, h: Hits, ext: np.ndarray, fits: np.ndarray, live: np.ndarray, given: np.ndarray, added) -> tuple[np.ndarray, ...]:
        """Of each piece and detector, by detector: text, detector, characters and line feeds before it, whether all of it counts, what lines count, the bytes; the last two as sizes and all in a row."""
        n, own = len(self.rules), slice(h.begin, h.begin + len(h.cuts) - 1)
        feeds = np.flatnonzero(h.low == 10)
        # Each occurrence with each detector of its keyword
        many = self.many[h.word]
        one = np.repeat(np.arange(len(many)), many)
        which = self.of_word[self.first[h.word[one]] + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)]
        ok = fits[ext[own][h.text[one]], which] & live[own][h.text[one]]
        one, which = one[ok], which[ok]
        lined = self.one_line[which]
        fit = [(t * n + d) for d in self.always for t in [np.flatnonzero(given[own] & fits[ext[own], d])]]
        whole = np.unique(np.concatenate([h.text[one[~lined]] * n + which[~lined], *fit]))
        one, which = one[lined], which[lined]
        text, at = h.text[one], np.searchsorted(feeds, h.place[one])
        if added is not None:
            key = (text + h.begin) << 32 | at - np.searchsorted(feeds, h.cuts[text]) + 1
            run = np.searchsorted(added[1], key, "right") - 1
            ok = (run >= 0) & (key <= added[2][run]) if len(added[1]) else np.zeros(len(key), bool)
            text, at, which = text[ok], at[ok], which[ok]
        wide = len(feeds) + 1
        lines = np.unique((text * wide + at) * n + which)
        # Pieces by text, a whole one before lines
        w_piece, w_many = np.unique(whole // n, return_counts=True)
        l_piece, l_many = np.unique(lines // n, return_counts=True)
        l_text, l_at = l_piece // wide, l_piece % wide
        edge = np.concatenate([[-1], feeds, [len(h.data)]])
        start = np.concatenate([h.cuts[w_piece], np.maximum(h.cuts[l_text], edge[l_at] + 1)])
        stop = np.concatenate([h.cuts[w_piece + 1], np.minimum(h.cuts[l_text + 1], edge[l_at + 1])])
        text = np.concatenate([w_piece, l_text])
        line = np.concatenate([np.zeros(len(w_piece), np.int64), l_at - np.searchsorted(feeds, h.cuts[l_text])])
        chars = np.concatenate([[0], np.cumsum((h.data & 0xC0) != 0x80)])
        # By detector, so that an expression is compiled once for all pieces of a batch
        detectors = np.concatenate([whole % n, lines % n])
        order = np.argsort(detectors, kind="stable")
        of = np.repeat(np.arange(len(text)), np.concatenate([w_many, l_many]))[order]
        start, stop, text, line, sure = start[of], stop[of], text[of], line[of], of >= len(w_piece)
        offset, size = chars[start] - chars[h.cuts[text]], stop - start
        if added is None:
            sure, lined = np.ones(len(of), bool), (np.zeros(len(of), np.int64), np.zeros(0, np.uint8))
        else:
            lined = self._lines(h, feeds, added, np.where(sure, -1, text))
        return text + h.begin, detectors[order], offset, line, sure, lined, (size, h.data[spread(start, size)])

    def _lines(self, h: Hits, feeds: np.ndarray, added, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text a byte a line, 1 where it is added; nothing for -1."""
        first = np.searchsorted(feeds, h.cuts) + np.arange(len(h.cuts))
        runs = slice(added[0][h.begin], added[0][h.begin + len(h.cuts) - 1])
        of = (added[1][runs] >> 32) - h.begin
        low, high = np.maximum(added[1][runs] & LINE, 1), np.minimum(added[2][runs] & LINE, np.diff(first)[of])
        some = low <= high
        edge = np.bincount(first[of[some]] + low[some] - 1, minlength=first[-1] + 1) - np.bincount(first[of[some]] + high[some], minlength=first[-1] + 1)
        many = np.where(text < 0, 0, np.diff(first)[text])
        return many, (np.cumsum(edge) > 0).astype(np.uint8)[spread(first[text], many)]


def _ends(sizes: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one stretch after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def pieces(texts: DataFrame, keep: tuple[str, ...], rules: list[Rule]) -> DataFrame:
    """(keep, PIECE_COLUMNS) of texts (keep, content, ext and, if only lines that it adds count, patch): a row for each piece and each detector that has to look at it."""
    workers_find_package(texts.sparkSession)
    cutter, patched = Cutter(rules), "patch" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns, strict=True))
            for text, rows in cutter.cut(of["content"], of["ext"], runs(of["patch"]) if patched else None):
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([*(of[c].take(at) for c in keep), *rows.columns], names=[*keep, *rows.schema.names])

    kept = StructType([texts.schema[c] for c in keep])
    return texts.mapInArrow(run, StructType([*kept.fields, *StructType.fromDDL(PIECE_COLUMNS).fields]))
