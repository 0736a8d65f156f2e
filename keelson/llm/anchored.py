"""Exact removal of repeated windows, found through sampled anchors.

Shared by the two substring operators. A scheme names, for every document, anchors: places
that any two equal windows have in common. Three rounds follow, all of them packed (a row
holds the records of many anchors) and all of them linear in the text:

1. keys: which anchor keys stand in two or more documents at all;
2. contexts: for those, which blocks (the text that all windows of an anchor span) are equal;
   every block but the first of its kind, by document id, repeats as a whole;
3. windows: first blocks whose key also has other contexts are compared window by window: as
   bytes, together with all blocks of their key (scheme.phrases), where a key has no more than
   scheme.limit contexts; by 128-bit names of single windows, dealt by name, beyond.

Hot keys cannot pile up: a worker sends scheme.few records for a key from each 8 MB of text at
most, and answers the other documents of that text itself. The text is dealt by doc_id once;
the plan uses that exchange again in each round. No round needs the driver.

Blocks are equal if a key (32 bits and its bucket) and an independent 64-bit hash agree, windows
by 128 bits, or byte by byte. Answers are by doc_id and content; ranges also name the text they
are for, as rows may repeat a doc_id with other texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FLUSH_BYTES, PASS_BYTES, bucket_of, by_bucket, pack_deltas, passes, run_lengths, runs, spread, text_bytes, texts, tune, unpack_deltas
from .kernels import flat, mix, slices

PACKED = "bucket int, kind int, k binary, c binary, d binary, f binary"
REPLY = "doc_id long, kind int, codes binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("k", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("f", pa.binary())])
_REPLY = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("codes", pa.binary())])
RECORDS, REPLIES = 0, 16
KEY, FULL, OPEN, NAMED, FULL_RANGE, OPEN_RANGE, WINDOW = range(7)
BLOCKS = 1
#: Bits of a range's end that are the place in the text.
_PLACE = np.uint64((1 << 40) - 1)


class Scheme:
    """What a substring operator adds: its unit, window width and anchors.

    scan(buf, offsets) returns a Scan. Positions are in units (bytes or words) of the batch.
    """

    width: int
    #: Contexts of a key in one stretch of text, and in all, up to which blocks are compared as bytes.
    few, limit = 1, 1

    def scan(self, buf: np.ndarray, offsets: np.ndarray) -> Scan:
        raise NotImplementedError

    def windows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """What a Scan has as units and window, without the anchors."""
        raise NotImplementedError

    def phrases(self, text: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of blocks of text, back to back: (doc_id, name) of the windows that stand in a block of a smaller doc_id."""
        raise NotImplementedError


class Scan:
    def __init__(self, units: np.ndarray, doc: np.ndarray, key: np.ndarray, context: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, window: Callable[[np.ndarray], np.ndarray], second: Callable[[np.ndarray], np.ndarray]):
        """units: for each document its first unit. low, high: the first and last window start that an anchor owns.

        context: a hash of the blocks of some anchors. window, second: two independent hashes of windows by their start.
        """
        self.units, self.doc, self.key, self.context, self.low, self.high, self.window, self.second = units, doc, key, context, low, high, window, second


def code1(key: np.ndarray, n: int) -> np.ndarray:
    """What the first rounds keep of a key: 32 bits besides the bucket. A clash only sends an anchor on to the next round."""
    return (bucket_of(key, n).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def among(doc: np.ndarray, code: np.ndarray, in_doc: np.ndarray, in_code: np.ndarray) -> np.ndarray:
    """Which (doc, code) pairs are among the others."""
    if not len(in_code) or not len(code):
        return np.zeros(len(code), bool)
    salt = lambda d: mix(d.astype(np.uint64) + np.uint64(1))
    there = np.sort(in_code ^ salt(in_doc))
    x = code ^ salt(doc)
    at = np.searchsorted(there, x)
    at[at == len(there)] = 0
    return there[at] == x


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All positions of inclusive ranges."""
    n = high - low + 1
    return np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(low) else np.zeros(0, np.int64)


def packed_rows(bucket_count: int, key: np.ndarray, ids: np.ndarray, context: np.ndarray | None = None, flag: np.ndarray | None = None, short: bool = False) -> pa.RecordBatch | None:
    if not len(key):
        return None
    by_document = np.argsort(ids, kind="stable")
    order, begin = by_bucket(bucket_of(key[by_document], bucket_count), bucket_count)
    order = by_document[order]
    key, ids = key[order], ids[order]
    context, flag = (None if x is None else x[order] for x in (context, flag))
    rows: list[tuple] = []
    for b in np.flatnonzero(np.diff(begin)).tolist():
        s = slice(begin[b], begin[b + 1])
        k = (key[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32) if short else key[s]
        rows.append((b, RECORDS, k.tobytes(), None if context is None else context[s].tobytes(), pack_deltas(ids[s]), None if flag is None else np.packbits(flag[s]).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)


def packed_blocks(bucket_count: int, key: np.ndarray, ids: np.ndarray, size: np.ndarray, text: np.ndarray) -> pa.RecordBatch | None:
    """Blocks of text, which lie back to back, by the bucket of their key."""
    if not len(key):
        return None
    order, begin = by_bucket(bucket_of(key, bucket_count), bucket_count)
    at = np.cumsum(size) - size
    text = text[spans(at[order], (at + size - 1)[order])]
    key, ids, size = key[order], ids[order], size[order]
    ends = np.concatenate([[0], np.cumsum(size)])
    rows = [(b, BLOCKS, key[x:y].tobytes(), text[ends[x] : ends[y]].tobytes(), pack_deltas(ids[x:y]), size[x:y].astype(np.uint16).tobytes()) for b, x, y in zip(range(bucket_count), begin[:-1].tolist(), begin[1:].tolist(), strict=True) if x < y]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)


def passed_on(kind: int, ids: np.ndarray, code: np.ndarray, bucket_count: int) -> pa.RecordBatch | None:
    """Answers that are known already travel with the records, as rows of their own."""
    if not len(ids):
        return None
    order = np.argsort(ids, kind="stable")
    parts = min(bucket_count, max(1, len(ids) >> 14))
    # The two ends of a range stay in one row: rows come back in any order
    each = 2 if kind in (FULL_RANGE, OPEN_RANGE) else 1
    cuts = np.array_split(order.reshape(-1, each), parts)
    rows = [(int((ids[x[0]] + i) % bucket_count), REPLIES + kind, code[x].tobytes(), None, ids[x].tobytes(), None) for i, x in enumerate(c.ravel() for c in cuts) if len(x)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)


def replies(kind: int, ids: np.ndarray, code: np.ndarray) -> pa.RecordBatch | None:
    """A row for each document, with its codes."""
    if not len(ids):
        return None
    order = np.argsort(ids, kind="stable")
    ids, code = ids[order], np.ascontiguousarray(code[order])
    begin = runs(ids)
    offsets = np.append(begin, len(ids)).astype(np.int32) * 8
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(code)])
    return pa.RecordBatch.from_arrays([pa.array(ids[begin]), pa.array(np.full(len(begin), kind, np.int32)), blobs], schema=_REPLY)


def documents(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[tuple]:
    """(ids, buf, offsets, marks, bytes) for each pass; marks(kind) gives (document in the pass, code)."""
    for batch in batches:
        for a, b in passes(batch.column("text")):
            part = batch.slice(a, b - a)
            ids = np.asarray(part.column("doc_id").fill_null(0))
            known = np.asarray(part.column("doc_id").is_valid())
            buf, offsets = flat(part.column("text"))
            marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            if marked:
                lists = part.column("marks")
                parent = np.asarray(pc.list_parent_indices(lists))
                rows = lists.flatten()
                kinds, blobs = np.asarray(rows.field("kind")), rows.field("codes")
                for kind in np.unique(kinds).tolist():
                    own = kinds == kind
                    chosen = blobs.filter(pa.array(own))
                    sizes = np.asarray(pc.binary_length(chosen), np.int64) // 8
                    marks[kind] = (np.repeat(parent[own], sizes), np.frombuffer(b"".join(chosen.to_pylist()), np.uint64))
            yield ids, known, buf, offsets, marks


def unique_rows(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by the first column, then the next, without repeats."""
    order = np.lexsort(columns[::-1])
    out = tuple(c[order] for c in columns)
    keep = runs(*out)
    return tuple(c[keep] for c in out)


class Gathered:
    """Records of several passes, until there are those of enough text."""

    def __init__(self, columns: int):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes, self.columns = 0, columns

    def add(self, size: int, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.bytes += size
        return self.bytes >= FLUSH_BYTES

    def take(self) -> tuple[np.ndarray, ...]:
        out = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.bytes = [], 0
        return out


def first_round(scheme: Scheme, n: int):
    def send(key, ids):
        key, ids = unique_rows(key, ids)
        begin = runs(key)
        size = run_lengths(begin, len(key))
        again = np.repeat(size > 1, size)
        yield passed_on(KEY, ids[again], code1(key[again], n), n)
        yield packed_rows(n, key[begin], ids[begin], flag=size > 1, short=True)

    def run(batches):
        held = Gathered(2)
        for ids, known, buf, offsets, _ in documents(batches, False):
            s = scheme.scan(buf, offsets)
            own = known[s.doc]
            if held.add(len(buf), s.key[own], ids[s.doc[own]]):
                yield from filter(None, send(*held.take()))
        if held.parts:
            yield from filter(None, send(*held.take()))

    return run


def compared(scheme: Scheme, blocks: list[tuple]) -> Iterator[pa.RecordBatch | None]:
    """Blocks of one bucket, all of a key together, some keys at a time."""
    key, ids, size, text = (np.concatenate(x) for x in zip(*blocks, strict=True))
    blocks.clear()
    order = np.argsort(key, kind="stable")
    at = (np.cumsum(size) - size)[order]
    key, ids, size = key[order], ids[order], size[order]
    begin = runs(key)
    for a, b in slices(np.add.reduceat(size, begin), PASS_BYTES) if len(key) else ():
        x, y = begin[a], begin[b] if b < len(begin) else len(key)
        yield replies(WINDOW, *scheme.phrases(text[spans(at[x:y], at[x:y] + size[x:y] - 1)], size[x:y], ids[x:y]))


def reduced(n: int, short: bool, decide: Callable[..., Iterator[pa.RecordBatch | None]], scheme: Scheme):
    """One bucket's records, together; answers that came along go on at once."""

    def run(batches):
        parts: list[tuple] = []
        blocks: list[tuple] = []
        bucket = 0
        for batch in batches:
            kinds = np.asarray(batch.column("kind"))
            for i, kind in enumerate(kinds.tolist()):
                k = batch.column("k")[i].as_py()
                if kind >= REPLIES:
                    yield replies(kind - REPLIES, np.frombuffer(batch.column("d")[i].as_py(), np.int64), np.frombuffer(k, np.uint64))
                    continue
                bucket = batch.column("bucket")[i].as_py()
                c, f = batch.column("c")[i].as_py(), batch.column("f")[i].as_py()
                if kind == BLOCKS:
                    key = np.frombuffer(k, np.uint64)
                    blocks.append((key, unpack_deltas(batch.column("d")[i].as_py(), len(key)), np.frombuffer(f, np.uint16).astype(np.int64), np.frombuffer(c, np.uint8)))
                    continue
                key = np.frombuffer(k, np.uint32 if short else np.uint64)
                parts.append((key, unpack_deltas(batch.column("d")[i].as_py(), len(key)), np.zeros(0, np.uint64) if c is None else np.frombuffer(c, np.uint64), np.zeros(0, bool) if f is None else np.unpackbits(np.frombuffer(f, np.uint8), count=len(key)).astype(bool)))
        if parts:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts.clear()
            yield from filter(None, decide(bucket, *columns))
        if blocks:
            yield from filter(None, compared(scheme, blocks))

    return run


def decide_keys(bucket, key, ids, _, flag):
    order = np.argsort(key, kind="stable")
    key, ids, flag = key[order], ids[order], flag[order]
    begin = runs(key)
    size = run_lengths(begin, len(key))
    several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
    told = np.repeat(several, size) & ~flag
    yield replies(KEY, ids[told], (np.uint64(bucket) << np.uint64(32)) | key[told].astype(np.uint64))


def second_round(scheme: Scheme, n1: int, n: int):
    def send(key, context, ids):
        key, context, ids = unique_rows(key, context, ids)
        block = runs(key, context)
        first = np.zeros(len(key), bool)
        first[block] = True
        yield passed_on(FULL, ids[~first], context[~first], n)
        bk, bc, bd = key[block], context[block], ids[block]
        begin = runs(bk)
        size = run_lengths(begin, len(bk))
        many = np.repeat(size > scheme.few, size)
        yield passed_on(NAMED, bd[many], bc[many], n)
        sent = ~many
        sent[begin] = True
        yield packed_rows(n, bk[sent], bd[sent], context=np.where(many, np.uint64(0), bc)[sent], flag=many[sent], short=True)

    def run(batches):
        held = Gathered(3)
        for ids, known, buf, offsets, marks in documents(batches, True):
            s = scheme.scan(buf, offsets)
            own = np.flatnonzero(known[s.doc] & among(s.doc, code1(s.key, n1), *marks.get(KEY, (np.zeros(0, np.int64), np.zeros(0, np.uint64)))))
            if held.add(len(buf), s.key[own], s.context(own), ids[s.doc[own]]):
                yield from filter(None, send(*held.take()))
        if held.parts:
            yield from filter(None, send(*held.take()))

    return run


def decide_contexts(scheme: Scheme):
    return lambda bucket, key, ids, context, flag: _decide_contexts(scheme.limit, key, ids, context, flag)


def _decide_contexts(limit, key, ids, context, flag):
    order = np.lexsort((ids, context, flag, key))
    key, ids, context, flag = key[order], ids[order], context[order], flag[order]
    begin = runs(key)
    size = run_lengths(begin, len(key))
    block = runs(key, flag, context)
    block_size = run_lengths(block, len(key))
    blocks_of_key = np.searchsorted(block, np.append(begin, len(key)))
    several = (np.diff(blocks_of_key) > 1) | np.maximum.reduceat(flag, begin)
    several_row = np.repeat(several, size)
    many = np.repeat((np.diff(blocks_of_key) > limit) | np.maximum.reduceat(flag, begin), size)
    least = np.repeat(ids[block], block_size)
    full = ~flag & (ids > least)
    yield replies(FULL, ids[full], context[full])
    first = np.zeros(len(key), bool)
    first[block] = True
    opened = first & ~flag & several_row
    yield replies(OPEN, ids[opened & ~many], context[opened & ~many])
    yield replies(NAMED, ids[opened & many], context[opened & many])


def third_round(scheme: Scheme, n: int):
    def named(window, second, ids):
        window, second, ids = unique_rows(window, second, ids)
        begin = runs(window, second)
        first = np.zeros(len(window), bool)
        first[begin] = True
        yield passed_on(WINDOW, ids[~first], window[~first], n)
        yield packed_rows(n, window[begin], ids[begin], context=second[begin])

    def ranges(kind, s, ids, mark, chosen):
        if not chosen.any():
            return None
        doc, low, high = s.doc[chosen], s.low[chosen] - s.units[s.doc[chosen]], s.high[chosen] - s.units[s.doc[chosen]]
        order = np.lexsort((low, doc))
        doc, low, high = doc[order], low[order], high[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)
        at = np.flatnonzero(new)
        doc, low, high = doc[at], low[at], np.maximum.reduceat(high, at)
        return passed_on(kind, np.repeat(ids[doc], 2), (mark[doc] | np.stack([low, high], 1).astype(np.uint64)).ravel(), n)

    def run(batches):
        held, blocks = Gathered(3), Gathered(4)
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for ids, known, buf, offsets, marks in documents(batches, True):
            s = scheme.scan(buf, offsets)
            mark = text_marks(buf, offsets)
            context = s.context(np.arange(len(s.doc)))
            full = among(s.doc, context, *marks.get(FULL, none))
            many = among(s.doc, context, *marks.get(NAMED, none)) & ~full
            opened = among(s.doc, context, *marks.get(OPEN, none)) & ~full & ~many
            yield from filter(None, [ranges(FULL_RANGE, s, ids, mark, full), ranges(OPEN_RANGE, s, ids, mark, opened | many)])
            at = spans(s.low[many], s.high[many])
            owner = np.repeat(s.doc[many], s.high[many] - s.low[many] + 1)
            if held.add(len(buf), s.window(at), s.second(at), ids[owner]):
                yield from filter(None, named(*held.take()))
            if opened.any():
                once = np.flatnonzero(opened)
                once = once[np.unique(context[once] ^ mix(s.doc[once].astype(np.uint64)), return_index=True)[1]]
                low, high = s.low[once], s.high[once] + scheme.width - 1
                if blocks.add(len(buf), s.key[once], ids[s.doc[once]], high - low + 1, buf[spans(low, high)]):
                    yield from filter(None, [packed_blocks(n, *blocks.take())])
        if held.parts:
            yield from filter(None, named(*held.take()))
        if blocks.parts:
            yield from filter(None, [packed_blocks(n, *blocks.take())])

    return run


def decide_windows(bucket, window, ids, second, *_):
    order = np.lexsort((ids, second, window))
    window, second, ids = window[order], second[order], ids[order]
    begin = runs(window, second)
    least = np.repeat(ids[begin], run_lengths(begin, len(window)))
    again = ids > least
    yield replies(WINDOW, ids[again], window[again])


def text_marks(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text 24 bits that go above the low end of its ranges and 24 above the high end: they tell rows of one doc_id apart."""
    bounds = offsets.tolist()
    x = np.array([xxhash.xxh3_64_intdigest(buf[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64)
    return np.stack([x & ~_PLACE, x << np.uint64(24) & ~_PLACE], 1)


def repeated(scheme: Scheme, buf: np.ndarray, offsets: np.ndarray, marks: dict) -> np.ndarray:
    """The window starts that repeat a window of an earlier document, in units of the pass."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    mark = text_marks(buf, offsets)
    units, window = scheme.windows(buf, offsets)

    def positions(kind):
        doc, x = marks.get(kind, none)
        doc, x = doc[::2], x.reshape(-1, 2)
        own = ((x & ~_PLACE) == mark[doc]).all(1)
        doc, x = doc[own], (x[own] & _PLACE).astype(np.int64)
        x += units[doc][:, None]
        return spans(x[:, 0], x[:, 1]), np.repeat(doc, x[:, 1] - x[:, 0] + 1)

    full, _ = positions(FULL_RANGE)
    at, owner = positions(OPEN_RANGE)
    again = among(owner, window(at), *marks.get(WINDOW, none))
    return np.concatenate([full, at[again]])


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n units lie in a window that begins at one of the starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1) if len(starts) < 64 else d.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    stop = np.bincount(starts + width, minlength=n + 1)[: n + 1] if len(starts) else np.zeros(n + 1, np.int64)
    return np.cumsum(d - stop)[:n] > 0


def removal(docs: DataFrame, scheme: Scheme, finish: Callable, schema: str) -> DataFrame:
    """Applies the rounds; finish(batches) turns (doc_id, text, marks) into the result."""
    spark = docs.sparkSession
    tune(spark)
    docs = texts(docs)
    total = text_bytes(docs)
    n, parts = spread(total, 32 << 20), spread(total, 48 << 20)
    # The same filter for all joins, or Catalyst would add one to some and the exchange would run twice
    dealt = docs.where("doc_id is not null").repartition(parts, "doc_id")

    def together(sent: DataFrame, short: bool, decide) -> DataFrame:
        rows = sent.repartitionById(n, F.col("bucket")).mapInArrow(reduced(n, short, decide, scheme), REPLY)
        return rows.repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("kind", "codes")).alias("marks"))

    keys = together(dealt.mapInArrow(first_round(scheme, n), PACKED), True, decide_keys)
    blocks = together(dealt.join(keys, "doc_id").mapInArrow(second_round(scheme, n, n), PACKED), True, decide_contexts(scheme))
    windows = together(dealt.join(blocks, "doc_id").mapInArrow(third_round(scheme, n), PACKED), False, decide_windows)
    nameless = docs.where("doc_id is null").withColumn("marks", F.lit(None).cast("array<struct<kind:int,codes:binary>>"))
    return dealt.join(windows, "doc_id", "left").unionByName(nameless).mapInArrow(finish, schema)
