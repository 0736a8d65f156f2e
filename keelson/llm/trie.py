"""The prefix trie of conversations (operator 12).

A turn is 128 bits (MD5 of role and text, the role's length before them) and the bytes of its
text; a conversation is the array of its turns. Arrays are sorted over the whole cluster by
range, ties by conv_id, so that a conversation that a third of all rows repeats is dealt over
many tasks. Each task sweeps its stretch: from the length of the prefix that two neighbours
share follows which nodes end and which begin, on a stack of open nodes. Nodes that begin and
end within a stretch are done there. Those on the path of its first or last conversation may go
on next door: they leave as parts, and one more sweep, over two paths a stretch, joins them.
This sweep is one task; it reads some 2 x depth rows for each STRETCH turns and keeps a path.

Order of turns: turn, nulls first, ties by the turn's MD5 (hexadecimal). Null roles and texts are
empty. Rows without conv_id take no part; an empty table gives no nodes, not even a root. Repeated
rows are turns of their own. Texts are hashed whole where they are read and go no further. A
conversation is one row from then on, 24 bytes a turn. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored, tune

#: Turns that a task sweeps, on average.
STRETCH = 1 << 19
#: Bytes of a list of ids that a row carries.
CHUNK = 1 << 16
W = 16
PARTS = "kind int, part int, seq long, id binary, parent binary, depth long, turn binary, size long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
NAMES = [c.split(" ")[0] for c in PARTS.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split(" ")[1]] for c in PARTS.split(", ")]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, turn, size): each turn's place from 0, hash and bytes of text."""
    from pyspark.sql import Window

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), digest.alias("turn"), F.octet_length(text).cast("long").alias("size")).where("conv_id is not null")
    place = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "turn")
    return rows.select("conv_id", (F.row_number().over(place) - 1).alias("p"), "turn", "size")


def rebuilt(rows: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin like the first of their family: (conv_id, p, turn, size, own).

    The first h turns of conversation c are those of c - c % family, the rest its own;
    h = crc32(decimal c) % most. Rows with own null only say that there is a conversation; rows
    of conversations that are not there have no own ones beside them.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = F.col("conv_id") - F.col("conv_id") % family
    own = rows.withColumn("own", (F.col("p") >= h) | (first == F.col("conv_id"))).select("conv_id", "p", F.when(F.col("own"), F.col("turn")).alias("turn"), "size", F.lit(1).alias("own"))
    heads = rows.where(f"p < {most - 1} and conv_id % {family} = 0")
    kin = heads.select(F.col("conv_id").alias("of"), F.explode(F.sequence(F.col("conv_id") - family + 1, F.col("conv_id") + family - 1)).alias("conv_id"), "p", "turn", "size")
    kin = kin.where((F.col("of") == first) & (F.col("of") != F.col("conv_id")) & (F.col("p") < h))
    return own.unionByName(kin.select("conv_id", "p", "turn", "size", F.lit(0).alias("own")))


def arrays(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, sizes): own = 0 before own = 1, each by place."""
    turn = F.when(F.col("turn").isNotNull(), F.struct("own", "p", "turn", "size"))
    out = rows.groupBy("conv_id").agg(F.max("own").alias("there"), F.array_sort(F.collect_list(turn)).alias("x")).where("there = 1")
    return out.select("conv_id", F.unhex(F.array_join("x.turn", "")).alias("turns"), F.col("x.size").alias("sizes"))


class Node:
    __slots__ = ("turn", "size", "n", "least", "children", "leaves", "saved", "ends", "waiting", "id", "edge")

    def __init__(self, turn: bytes, size: int):
        self.turn, self.size, self.n, self.least = turn, size, 0, None
        self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.waiting: list[list] = []
        self.id: bytes | None = None
        self.edge = False

    def gain(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def totals(self) -> tuple[int, int]:
        """Leaves and saved tokens of the whole subtree, once all of it is known."""
        return self.leaves + (self.children == 0), self.saved + (self.n - 1) * self.size


def name(parent: bytes, turn: bytes) -> bytes:
    """A node by its path."""
    return hashlib.md5(parent + turn).digest()


def shared(a: bytes, b: bytes) -> int:
    """Turns that both begin with."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // W
    i = 0
    while a[i : i + W] == b[i : i + W]:
        i += W
    return i // W


def sweep(part: int, rows: Iterator[tuple[bytes, list[int], int]]) -> Iterator[list]:
    """Nodes of sorted conversations (kind 0), then the parts on the first and the last path (kind 1)."""
    root = Node(b"", 0)
    root.id, root.edge = name(b"", b""), True
    stack, first, was = [root], [], None

    def left(depth: int) -> Iterator[list]:
        node, parent = stack.pop(), stack[-1]
        if node.edge:
            return
        leaves, saved = node.totals()
        parent.gain(node.n, node.least, 1, leaves, saved)
        for row in node.waiting:
            row[9] = node.least
            yield row
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest().encode()
        row = [0, part, 0, None, None, depth, None, node.size, node.least, None, node.n, node.children, leaves, saved, ends]
        if parent.edge:
            row[4] = parent.id
            yield row
        else:
            parent.waiting.append(row)

    for key, sizes, conv in rows:
        common = 0 if was is None else shared(was, key)
        while len(stack) > common + 1:
            yield from left(len(stack) - 1)
        for i in range(common, len(key) // W):
            node = Node(key[W * i : W * i + W], sizes[i])
            if was is None:
                node.id, node.edge = name(stack[-1].id, node.turn), True
            stack.append(node)
        if was is None:
            first = list(stack)
        stack[-1].ends.append(conv)
        stack[-1].gain(1, conv, 0, 0, 0)
        was = key
    if was is None:
        return
    last = [(d, n) for d, n in enumerate(stack) if not n.edge]
    for d, node in last:
        node.id = name(stack[d - 1].id, node.turn)
        for row in node.waiting:
            row[4] = node.id
            yield row
    seq = 0
    for depth, node in [*enumerate(first), *last]:
        text = ",".join(map(str, node.ends)).encode()
        for at in range(0, max(1, len(text)), CHUNK):
            facts = [node.least, None, node.n, node.children, node.leaves, node.saved] if at == 0 else [None, None, 0, 0, 0, 0]
            # Chunks of one list follow each other without a comma between them
            yield [1 if at == 0 else 2, part, seq, node.id, None, depth, node.turn, node.size, *facts, text[at : at + CHUNK]]
            seq += 1


def stitched(rows: Iterator[dict]) -> Iterator[list]:
    """The nodes on the paths between stretches, from their parts in order."""
    stack: list[Node] = []

    def left() -> Iterator[list]:
        node = stack.pop()
        leaves, saved = node.totals()
        if stack:
            stack[-1].gain(node.n, node.least, 1, leaves, saved)
        yield [1, 0, 0, node.id, stack[-1].id if stack else None, len(stack), None, node.size, node.least, None, node.n, node.children, leaves, saved, node.ends[0].hexdigest().encode()]

    for r in rows:
        depth = r["depth"]
        if not (depth < len(stack) and stack[depth].id == r["id"]):
            while len(stack) > depth:
                yield from left()
            node = Node(r["turn"], r["size"])
            node.id, node.ends = r["id"], [hashlib.sha256(), False]
            stack.append(node)
        node = stack[depth]
        node.gain(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
        if r["ends"]:
            if node.ends[1] and r["kind"] == 1:
                node.ends[0].update(b",")
            node.ends[0].update(r["ends"])
            node.ends[1] = True
    while stack:
        yield from left()


def batched(rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
    some: list[list] = []
    for row in rows:
        some.append(row)
        if len(some) == 4096:
            yield _batch(some)
            some = []
    if some:
        yield _batch(some)


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def trie(convs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The nodes of conversations given as arrays (conv_id, turns, sizes).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    tune(convs.sparkSession)
    convs = stored(convs, "turns")
    total = convs.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]

    def swept(batches):
        def rows():
            for b in batches:
                yield from zip(b.column("turns").to_pylist(), b.column("sizes").to_pylist(), b.column("conv_id").to_pylist(), strict=True)

        from pyspark import TaskContext

        yield from batched(sweep(TaskContext.get().partitionId(), rows()))

    def joined(batches):
        yield from batched(stitched(r for b in batches for r in b.to_pylist()))

    dealt = convs.repartitionByRange(spread(total, stretch), "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    parts = stored(dealt.mapInArrow(swept, PARTS), "parts")
    paths = parts.where("kind > 0")
    on_paths = stored(paths.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(joined, PARTS), "paths")
    conv_of = on_paths.select(F.col("id").alias("parent"), F.col("conv_id").alias("found"))
    # By stretch and parent: the root has children in each stretch
    per_part = paths.where("kind = 1").select("part", F.col("id").alias("parent")).distinct().join(conv_of, "parent")
    inner = parts.where("kind = 0")
    hung = inner.where("parent is not null").join(per_part, ["part", "parent"]).withColumn("parent_conv_id", F.col("found"))
    ends = on_paths.join(conv_of, "parent", "left").withColumn("parent_conv_id", F.col("found"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").cast("string").alias("ends_sha256")]
    return inner.where("parent is null").select(*out).unionByName(hung.select(*out)).unionByName(ends.select(*out))


def prefix_trie(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The trie of rebuilt conversations."""
    return trie(arrays(rebuilt(turns(conversations))), stretch)
