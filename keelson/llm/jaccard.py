"""N-gram Jaccard join by universe partition (operator 2).

Two sets of sizes a <= b with Jaccard similarity t or more differ in at most
D = floor((a + b) (1 - t) / (1 + t)) elements. Hash values are cut into segments, a number
fixed for each size band, and a set is indexed by the contents of its segments. By the
pigeonhole principle, if segments are given thresholds -1 (not used), 0 (equal contents) or 1
(contents one deletion apart) whose sum, each plus one, exceeds D, then similar sets meet in
one of them. Costs decide who gets what: contents that consist of frequent shingles only, and
empty ones, are not used as long as others suffice; the last segments of a band, indexed with
their one-deletion neighbourhoods, count twice and make up for those; and a set stops as soon
as its sum suffices. Which class a segment falls in depends on its contents alone, so that
both sets of a pair come to the same use. Frequent contents, then empty ones, are used where
nothing else is left (large groups of near copies), so no link is lost.

Sets that share a key are compared with the first of them, exactly (shingles by 64-bit hashes:
within one pair of sets, even of 10^6 shingles each, two different ones agree with a chance of
10^-7); only where that leaves
members in different components, the others are compared too, the likeliest first. Before
texts travel for a comparison, the histograms of both sets over BINS bins of hash values bound
what they can have in common. Equal sets within 4 MB of text
are linked at once and indexed as one. Nothing but counts and a list of at most HEAVY
frequent shingles (1 MB of hashes; any list is right, a good one is fast) reaches the driver.

Texts: A-Z count as a-z, words are `[^\\x20\\x09-\\x0D]+`, sets hold distinct shingles of
five words; shorter texts have one shingle, null and blank ones none and link with nothing. A
null doc_id has a null component. Rows that repeat a doc_id are one node, which has the links
of each of their texts; each row keeps its own set size. Very long texts have very large sets,
in a size band of their own. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import _PACKED, PACKED, RECORDS, REPLIES, packed_rows, passed_on, unique_rows
from .common import FLUSH_BYTES, passes, run_lengths, runs, shared_dir, spread, stored, text_bytes, texts, tune, unpack_deltas
from .components import connected
from .kernels import U64, ascii_lower, distinct, flat, mix, shingles

#: Most frequent shingles that are told to all workers: 512 KB at most.
HEAVY = 1 << 17
#: A shingle in so many documents is frequent, as far as the list goes; and in so many of one stretch of text, it is counted.
FREQUENT, COUNTED = 8, 3
_PAIR = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("members", pa.binary()), ("parts", pa.int32())])
MET = "kind int, a long, b long, members binary, parts int"
CANDIDATE, EQUAL, BUCKET, HISTOGRAM, SIZE = range(5)
BINS, CLIP = 512, 15
#: Members of one list that one task compares with as many others.
BLOCK = 1024
CHUNK = 4096


class Thresholds:
    """Jaccard threshold as a ratio of whole numbers."""

    def __init__(self, numerator: int = 3, denominator: int = 4):
        self.p, self.q = numerator, denominator

    def partner(self, size):
        """Largest size that can be similar to this one."""
        return size * self.q // self.p

    def differ(self, total):
        """Most elements by which two similar sets of this total size differ."""
        return total * (self.q - self.p) // (self.q + self.p)


def memberships(size: np.ndarray, t: Thresholds) -> tuple[np.ndarray, ...]:
    """(set, group, segments without neighbourhoods, all segments, sum that suffices).

    Sizes fall in bands that double; each band is a group, and so is each border between two.
    """
    has = np.flatnonzero(size > 0)
    n = size[has]
    band = np.floor(np.log2(n)).astype(np.int64)
    low, top = 1 << band, (2 << band) - 1
    own = (has, 2 * band, t.differ(2 * top) + 1, t.differ(n + np.minimum(t.partner(n), top)) + 1)
    above = 2 << band  # the next band's least
    far = t.partner(above - 1)
    up = t.partner(n) >= above
    rise = (has[up], 2 * band[up] + 1, t.differ((above - 1 + far)[up]) + 1, t.differ((n + np.minimum(t.partner(n), far))[up]) + 1)
    under = t.partner(low - 1)
    down = (n <= under) & (low > 1)
    fall = (has[down], 2 * band[down] - 1, t.differ((low - 1 + under)[down]) + 1, t.differ((n + low - 1)[down]) + 1)
    who, group, plain, need = (np.concatenate(x) for x in zip(own, rise, fall, strict=True))
    return who, group, plain, plain + -(-plain * 35 // 100) + 6, need


def keys(values: np.ndarray, offsets: np.ndarray, heavy: np.ndarray, t: Thresholds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of sorted sets; for each the number of its set, and whether it need not meet others of this kind."""
    who, group, plain, segments, need = memberships(np.diff(offsets), t)
    if not len(who):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
    size = np.diff(offsets)[who]
    member = np.repeat(np.arange(len(who)), size)
    starts = np.cumsum(size) - size
    at = np.arange(len(member)) - starts[member] + offsets[:-1][who][member]
    v = values[at]
    if len(heavy):
        place = np.searchsorted(heavy, values)
        place[place == len(heavy)] = 0
        light = (heavy[place] != values)[at]
    else:
        light = np.ones(len(v), bool)
    segment = (((v >> U64(32)) * segments[member].astype(U64)) >> U64(32)).astype(np.int64)
    one = mix(v + U64(0x51ED270B0A1F39C1))
    begin = runs(member, segment)
    m, s = member[begin], segment[begin]
    content = np.add.reduceat(one, begin)
    rare = np.add.reduceat(light.astype(np.int64), begin)
    count = run_lengths(begin, len(v))
    first = np.searchsorted(m, np.arange(len(who)))

    def sums(x):
        """Of each membership, up to but without this segment; and in all."""
        c = np.concatenate([[0], np.cumsum(x)])
        return c[:-1] - c[first][m], c[np.append(first[1:], len(m))] - c[first]

    worth = np.where(s < plain[m], np.minimum(rare, 1), np.minimum(rare, 2))
    before, total = sums(worth)
    used = (rare > 0) & (before < need[m])
    short = need - total
    before, common = sums((rare == 0).astype(np.int64))
    used |= (rare == 0) & (before < short[m])
    label = mix(group[m].astype(U64) * U64(0x2545F4914F6CDD1D) + s.astype(U64))
    others = np.add.reduceat(light.astype(np.int64), np.searchsorted(member, np.arange(len(who))))
    fringe = (2 * others > need - 1) & (short > 0)
    out, owner, flag = [mix(content[used] + label[used])], [who[m[used]]], [(fringe[m] & (rare == 0))[used]]
    # Each infrequent shingle, of sets that need more
    single = light & (short > 0)[member]
    out.append(mix(v[single] + mix(group[member[single]].astype(U64) + U64(0x1B873593))))
    owner.append(who[member[single]])
    flag.append(np.zeros(len(out[-1]), bool))
    # One-deletion neighbourhoods, where they count
    near = used & (s >= plain[m]) & (rare > 1)
    each = np.repeat(near, count)
    if each.any():
        run = np.repeat(np.arange(len(begin)), count)[each]
        out.append(mix(content[run] - one[each] + label[run]))
        owner.append(who[m[run]])
        flag.append(np.zeros(len(run), bool))
    # Empty segments, where all others do not suffice
    for j in np.flatnonzero(short - common > 0).tolist():
        missing = int(short[j] - common[j])
        there = s[first[j] : first[j + 1] if j + 1 < len(who) else len(s)]
        empty = np.setdiff1d(np.arange(segments[j]), there)[:missing]
        out.append(mix(mix(group[j].astype(U64) * U64(0x2545F4914F6CDD1D) + empty.astype(U64))))
        owner.append(np.full(len(empty), who[j]))
        flag.append(np.full(len(empty), fringe[j]))
    return np.concatenate(out), np.concatenate(owner), np.concatenate(flag)


def sets(column, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    buf, offsets = flat(column)
    return *distinct(*shingles(ascii_lower(buf), offsets, width)), len(buf)


def frequent(width: int):
    """Shingles that many documents of one stretch of text hold, and in how many."""

    def tell(parts):
        all_values = np.sort(np.concatenate(parts))
        begin = runs(all_values)
        n = run_lengths(begin, len(all_values))
        on = n >= COUNTED
        return pa.RecordBatch.from_arrays([pa.array(all_values[begin[on]].view(np.int64)), pa.array(n[on])], names=["shingle", "n"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for a, b in passes(batch.column("text")):
                v, _, n = sets(batch.column("text").slice(a, b - a), width)
                parts.append(v)
                size += n
                if size >= FLUSH_BYTES:
                    yield tell(parts)
                    parts, size = [], 0
        if parts:
            yield tell(parts)

    return run


def histograms(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each set, how many hashes fall in each bin, up to CLIP, in half a byte."""
    n = len(offsets) - 1
    place = np.repeat(np.arange(n) * BINS, np.diff(offsets)) + (values & U64(BINS - 1)).astype(np.int64)
    h = np.minimum(np.bincount(place, minlength=n * BINS), CLIP).astype(np.uint8).reshape(n, BINS)
    return h[:, : BINS // 2] << 4 | h[:, BINS // 2 :]


def unfolded(blobs: pa.Array) -> np.ndarray:
    h = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, BINS // 2)
    return np.hstack([h >> 4, h & 15])


def possible(common, size_a, size_b, t: Thresholds):
    """Whether sets that have at most so much in common can be similar."""
    return t.q * common >= t.p * (size_a + size_b - common)


def bounded(t: Thresholds):
    """Whether two sets can be similar, from their sizes and histograms. What was clipped counts as common."""

    @F.arrow_udf("boolean")
    def run(size_a: pa.Array, a: pa.Array, size_b: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        x, y, m, n = unfolded(a), unfolded(b), np.asarray(size_a), np.asarray(size_b)
        over = np.minimum(m - x.sum(1, dtype=np.int64), n - y.sum(1, dtype=np.int64))
        return pa.array(possible(np.minimum(np.minimum(x, y).sum(1, dtype=np.int64) + over, np.minimum(m, n)), m, n, t))

    return run


def beside(kind: int, bucket: int, *columns: bytes | None) -> pa.RecordBatch:
    """A row that only travels with the records."""
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((bucket, REPLIES + kind, *columns), _PACKED.types, strict=True)], schema=_PACKED)


def index(width: int, heavy: np.ndarray, t: Thresholds, n: int):
    def send(parts) -> Iterator[pa.RecordBatch | None]:
        ids = np.concatenate([p[0] for p in parts])
        known = np.concatenate([p[3] for p in parts])
        size = np.concatenate([np.diff(p[2]) for p in parts])
        offsets = np.concatenate([[0], np.cumsum(size)])
        values = np.concatenate([p[1] for p in parts])
        yield beside(SIZE, int(ids[0] % n), None, size.tobytes(), ids.tobytes(), np.packbits(known).tobytes())
        full = (size > 0) & known
        mark = np.zeros((2, len(ids)), U64)
        if len(values):
            some = size > 0
            mark[0, some] = np.add.reduceat(mix(values + U64(7)), offsets[:-1][some])
            mark[1, some] = np.add.reduceat(mix(values + U64(11)), offsets[:-1][some])
        order = np.lexsort((ids, mark[1], mark[0], size))
        order = order[full[order]]
        begin = runs(size[order], mark[0][order], mark[1][order])
        first = np.repeat(order[begin], run_lengths(begin, len(order)))
        again = ids[order] > ids[first]
        yield passed_on(EQUAL, ids[order][again], ids[first][again].view(U64), n)
        keep = np.sort(order[begin])
        take = np.repeat(np.isin(np.arange(len(ids)), keep), size)
        key, owner, fringe = unique_rows(*keys(values[take], np.concatenate([[0], np.cumsum(size[keep])]), heavy, t))
        yield packed_rows(n, key, ids[keep][owner], flag=fringe, short=True)
        bins = histograms(values[take], np.concatenate([[0], np.cumsum(size[keep])]))
        for a in range(0, len(keep), 1024):
            one = slice(a, a + 1024)
            yield beside(HISTOGRAM, int((ids[keep[a]] + a) % n), bins[one].tobytes(), size[keep][one].tobytes(), ids[keep][one].tobytes(), None)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for a, b in passes(batch.column("text")):
                part = batch.slice(a, b - a)
                v, o, n = sets(part.column("text"), width)
                parts.append((np.asarray(part.column("doc_id").fill_null(0)), v, o, np.asarray(part.column("doc_id").is_valid())))
                size += n + 16 * (b - a)
                if size >= FLUSH_BYTES // 2:
                    yield from filter(None, send(parts))
                    parts, size = [], 0
        if parts:
            yield from filter(None, send(parts))

    return run


def meet(batches):
    """Of one bucket: each key's first set with each other, and who shares a key with at least two others."""

    def pairs(kind, a, b, members=None, parts=None):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(a), pa.array(b), pa.nulls(len(b), pa.binary()) if members is None else members, pa.nulls(len(b), pa.int32()) if parts is None else pa.array(parts)], schema=_PAIR)

    key, ids, fringe = [], [], []
    for batch in batches:
        for kind, k, c, d, f in zip(batch.column("kind").to_pylist(), *(batch.column(x) for x in "kcdf"), strict=True):
            if kind == REPLIES + HISTOGRAM:
                who, bins = np.frombuffer(d.as_py(), np.int64), k.as_py()
                blobs = pa.array([bins[i : i + BINS // 2] for i in range(0, len(bins), BINS // 2)], pa.binary())
                yield pairs(HISTOGRAM, who, np.frombuffer(c.as_py(), np.int64), blobs)
            elif kind == REPLIES + SIZE:
                who = np.frombuffer(d.as_py(), np.int64)
                known = np.unpackbits(np.frombuffer(f.as_py(), np.uint8), count=len(who)).astype(bool)
                yield pairs(SIZE, pa.array(who, mask=~known), np.frombuffer(c.as_py(), np.int64))
            elif kind >= REPLIES:
                yield pairs(EQUAL, np.frombuffer(k.as_py(), np.int64), np.frombuffer(d.as_py(), np.int64))
            elif kind == RECORDS:
                key.append(np.frombuffer(k.as_py(), np.uint32))
                ids.append(unpack_deltas(d.as_py(), len(key[-1])))
                fringe.append(np.unpackbits(np.frombuffer(f.as_py(), np.uint8), count=len(key[-1])).astype(bool))
    if not key:
        return
    # Cores first; a list without a core asks for nothing
    key, fringe, ids = unique_rows(np.concatenate(key), np.concatenate(fringe), np.concatenate(ids))
    begin = runs(key)
    n = run_lengths(begin, len(key))
    some = np.repeat((n > 1) & ~fringe[begin], n)
    key, fringe, ids = key[some], fringe[some], ids[some]
    if not len(key):
        return
    begin = runs(key)
    n = run_lengths(begin, len(key))
    lead = np.repeat(ids[begin], n)
    # The first of a long list has many partners: they are dealt over parts
    split = (n >> 10).astype(np.int32) + 1
    other = lead != ids
    a, b, parts = unique_rows(lead[other], ids[other], np.repeat(split, n)[other])
    yield pairs(CANDIDATE, a, b, parts=parts)
    same = np.add.reduceat(mix(mix(ids.view(U64) + U64(3)) + U64(3) + fringe.astype(U64)), begin)
    _, one = np.unique(same, return_index=True)
    one = one[n[one] > 2]
    end = begin + n
    rows = [(BUCKET, int(ids[begin[i]]), int(same[i].view(np.int64)), ids[x : min(x + CHUNK, end[i])].tobytes() + fringe[x : min(x + CHUNK, end[i])].tobytes(), int(split[i])) for i in one.tolist() for x in range(begin[i], end[i], CHUNK)]
    for x in range(0, len(rows), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[x : x + (1 << 14)], strict=True), _PAIR.types, strict=True)], schema=_PAIR)


def compare(width: int, t: Thresholds):
    """Rows in order of (a, part, other): the texts of a, then of those that it is compared with."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        group, leads = None, []
        for batch in batches:
            for x, y in passes(batch.column("text")):
                part = batch.slice(x, y - x)
                v, o, _ = sets(part.column("text"), width)
                a, p, other, doc = (np.asarray(part.column(c)) for c in ("a", "part", "other", "doc_id"))
                begin = runs(a, p, other)
                out = []
                for i, e in zip(begin.tolist(), np.append(begin[1:], len(a)).tolist(), strict=True):
                    if (a[i], p[i]) != group:
                        group, leads = (a[i], p[i]), []
                    if not other[i]:
                        leads += [v[o[j] : o[j + 1]].copy() for j in range(i, e)]
                        continue
                    linked = np.zeros(e - i, bool)
                    mine, size = v[o[i] : o[e]], np.diff(o[i : e + 1])
                    for lead in leads:
                        if not len(lead) or not len(mine):
                            continue
                        at = np.searchsorted(lead, mine)
                        at[at == len(lead)] = 0
                        c = np.concatenate([[0], np.cumsum(lead[at] == mine)])
                        both = c[o[i + 1 : e + 1] - o[i]] - c[o[i:e] - o[i]]
                        linked |= (both > 0) & (t.q * both >= t.p * (size + len(lead) - both))
                    out.append((np.full(e - i, a[i]), doc[i:e], linked))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=kind)

    return run


def verified(docs: DataFrame, pairs: DataFrame, parts: int, width: int, t: Thresholds) -> DataFrame:
    """Those of the pairs (a, b, part) that are similar, exactly: the text of b travels to the part of its a, as does that of a to each of its parts."""
    others = pairs.select("a", "part", F.lit(True).alias("other"), F.col("b").alias("doc_id"))
    own = pairs.select("a", "part").distinct().select("a", "part", F.lit(False).alias("other"), F.col("a").alias("doc_id"))
    asked = own.unionByName(others)
    rows = docs.repartition(parts, "doc_id").join(asked.repartition(parts, "doc_id"), "doc_id").select("doc_id", "text", "a", "part", "other")
    return rows.repartition(parts, "a", "part").sortWithinPartitions("a", "part", "other").mapInArrow(compare(width, t), "a long, b long, linked boolean").where("linked").select("a", "b")


def met_in(docs: DataFrame, width: int, t: Thresholds, n: int) -> DataFrame:
    """What the index finds: sizes and histograms of sets, equal sets, pairs and lists that share a key."""
    told = docs.mapInArrow(frequent(width), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    heavy = np.sort(np.asarray(told.orderBy(F.desc("n"), "shingle").limit(HEAVY).select("shingle").toArrow().column(0), np.int64).view(U64))
    sent = docs.mapInArrow(index(width, heavy, t, n), PACKED).repartitionById(n, F.col("bucket"))
    return stored(sent.mapInArrow(meet, MET), "met", "kind")


def similar(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """(doc_id, component_id) of all documents that are linked with a document of smaller id, directly or not."""
    return _similar(docs, width, Thresholds(*threshold))[0]


def _similar(docs: DataFrame, width: int, t: Thresholds) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    tune(spark)
    shared_dir(spark)
    docs = texts(docs)
    total = text_bytes(docs)
    n, parts = spread(total, 32 << 20), spread(total, 48 << 20)
    met = met_in(docs, width, t, n)
    # Rows that repeat a doc_id with another set have a histogram each
    bins = met.where(F.col("kind") == HISTOGRAM).select(F.col("a").alias("doc_id"), F.col("b").alias("size"), F.col("members").alias("bins")).distinct()
    met_pairs = met.where(F.col("kind") == CANDIDATE).groupBy("a", "b").agg(F.max("parts").alias("parts"))
    pairs = stored(met_pairs.select("a", "b", F.expr("pmod(xxhash64(b), parts)").cast("long").alias("part")), "pairs")
    sides = [bins.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"), F.col("bins").alias(f"bins_{c}")) for c in "ab"]
    leads = pairs.select("a", "part").distinct().join(sides[0], "a")
    near = pairs.join(leads, ["a", "part"]).join(sides[1], "b").where(bounded(t)("size_a", "bins_a", "size_b", "bins_b")).select("a", "b", "part").distinct()
    links = met.where(F.col("kind") == EQUAL).select("a", "b").unionByName(verified(docs, stored(near, "near"), parts, width, t))
    found = connected(links)
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # First the likeliest pairs between components, which join most of them, then all that the bound allows
    for best in (2, None):
        more = stored(left_over(met, bins, pairs, tested, found, best, t), "rest")
        if more.isEmpty():
            continue
        so_far = found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        found = connected(so_far.unionByName(verified(docs, more, parts, width, t)))
        tested = tested.unionByName(more.select("a", "b"))
    return found, met


def left_over(met: DataFrame, bins: DataFrame, pairs: DataFrame, tested: DataFrame, found: DataFrame, best: int | None, t: Thresholds) -> DataFrame:
    """Pairs that share a key, stand in different components, can be similar and have not been compared.

    best: no more than so many of each component within a list. Long lists are met in blocks.
    """

    def label(df, c):
        of = found.select(F.col("doc_id").alias(c), F.col("component_id").alias(f"{c}_of"))
        return df.join(of, c, "left").withColumn(f"{c}_of", F.coalesce(f"{c}_of", c))

    first = label(pairs.select("a", "part").distinct(), "a")
    leads = label(pairs.join(first, ["a", "part"]), "b").where("a_of <> b_of").select("a").distinct()
    lists = met.where(F.col("kind") == BUCKET).select("a", "members", "parts").join(leads, "a", "left_semi")

    def spell(batches):
        for batch in batches:
            for a, blob, parts in zip(*(batch.column(c).to_pylist() for c in ("a", "members", "parts")), strict=True):
                n = len(blob) // 9
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, a)), pa.array(np.frombuffer(blob, np.int64, n)), pa.array(np.frombuffer(blob, bool, n, 8 * n)), pa.array(np.full(n, parts, np.int32))], names=["a", "doc", "fringe", "parts"])

    rows = label(lists.mapInArrow(spell, "a long, doc long, fringe boolean, parts int").groupBy("a", "doc").agg(F.min("fringe").alias("fringe"), F.max("parts").alias("parts")), "doc")
    size = rows.groupBy("a").agg(F.min("doc_of").alias("x"), F.max("doc_of").alias("y"), F.expr(f"ceil(count(*) / {BLOCK})").alias("blocks"), F.max("parts").alias("parts")).where("x < y")
    # A long list takes the number of its blocks in as many parts
    size = size.select("a", "blocks", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    rows = rows.withColumn("part", F.expr("pmod(xxhash64(doc), parts)").cast("int")).join(size, ["a", "part"]).join(bins.withColumnRenamed("doc_id", "doc"), "doc")
    rows = rows.withColumn("own", F.expr("pmod(xxhash64(doc), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64())])

    def cross(table: pa.Table) -> pa.Table:
        doc, of, fringe, n, own, i, j = (table.column(c).to_numpy() for c in ("doc", "doc_of", "fringe", "size", "own", "i", "j"))
        h = unfolded(table.column("bins").combine_chunks())
        over = n - h.sum(1, dtype=np.int64)
        out = []
        left = np.flatnonzero(own == i[0])
        right = np.flatnonzero(own == j[0])
        for x in range(0, len(left), 32):
            a = left[x : x + 32]
            close = (of[a][:, None] != of[right]) & ~(fringe[a][:, None] & fringe[right])
            close &= (t.q * n[a][:, None] >= t.p * n[right]) & (t.q * n[right] >= t.p * n[a][:, None])
            if i[0] == j[0]:
                close &= doc[a][:, None] < doc[right]
            p, q = np.nonzero(close)
            for y in range(0, len(p), 1 << 16):
                u, v = a[p[y : y + (1 << 16)]], right[q[y : y + (1 << 16)]]
                common = np.minimum(np.minimum(h[u], h[v]).sum(1, dtype=np.int64) + np.minimum(over[u], over[v]), np.minimum(n[u], n[v]))
                ok = possible(common, n[u], n[v], t)
                out.append((u[ok], v[ok], common[ok] / (n[u] + n[v] - common)[ok]))
        u, v, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        if best is not None and len(u):
            both, side = np.concatenate([of[u], of[v]]), np.tile(np.arange(len(u)), 2)
            order = np.lexsort((-score[side], both))
            begin = runs(both[order])
            rank = np.arange(len(order)) - np.repeat(begin, run_lengths(begin, len(order)))
            chosen = np.unique(side[order][rank < best])
            u, v = u[chosen], v[chosen]
        return pa.Table.from_arrays([pa.array(np.minimum(doc[u], doc[v])), pa.array(np.maximum(doc[u], doc[v])), pa.array(np.full(len(u), (int(i[0]) << 31) + int(j[0]) if len(i) else 0))], schema=kind)

    more = rows.groupBy("a", "i", "j").applyInArrow(cross, "a long, b long, part long").groupBy("a", "b").agg(F.min("part").alias("part"))
    return more.join(tested, ["a", "b"], "left_anti")


def join(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """A row for each document: doc_id, size of its shingle set, least doc_id that links lead to."""
    found, met = _similar(docs, width, Thresholds(*threshold))
    own = met.where(F.col("kind") == SIZE).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    return own.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
