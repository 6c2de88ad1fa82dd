"""Operator 13: the trie of conversation prefixes, from adaptive radix trees over turn ids.

A turn's id is 16 bytes, big-endian, of the digest of its role and text. A conversation is a key of such ids, cut into
pieces of bounded length, so that neither a long conversation nor a prefix that many share has to fit one task: pieces are
sorted by where they hang and what they hold and dealt by ranges, and each task puts its pieces into radix trees whose
nodes grow from 4 to 16, 48 and 256 places and whose single paths are compressed. Only depths at the end of a turn are
nodes of the trie. The trees' partial counts meet in one aggregate by node; a node is named by its depth and the xor of
its turns' digests, each taken with its place.

A node belongs to its smallest member, so each conversation owns the lower end of its own path. A sum over a subtree is
then what all members own in total, less what the owner holds above the node; the trees add up the first in a second
pass, and the second is a running sum along each conversation.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.common import WORD, keep

TURN = 16  # bytes of a turn's id
PIECE = 512  # turns
#: Bytes of the keys of one tree.
TREE = 1 << 22
#: Depths of one block of a running sum.
BLOCK = 4096
#: Ids of one text that is handed to a digest.
SEGMENT = 4096
_HEAD = 24  # bytes before a piece's turns: its depth and the node it hangs from


class Node:
    """A node of a radix tree: ``path`` leads to it from its parent, ``example`` is a key that passes through it.

    Up to 4 and 16 children stand in order of their bytes; up to 48 are found through 256 places; more have a place each.
    """

    __slots__ = ("path", "example", "low", "sums", "size", "bytes", "kids")

    def __init__(self, path: bytes, example, low: int, sums: list[int]):
        self.path, self.example, self.low, self.sums = path, example, low, sums
        self.size, self.bytes, self.kids = 4, b"", []

    def child(self, byte: int) -> Node | None:
        if self.size == 256:
            return self.kids[byte]
        if self.size == 48:
            at = self.bytes[byte]
            return self.kids[at - 1] if at else None
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> None:
        """Add a child, or replace the one at this byte."""
        if self.size == 256:
            self.kids[byte] = node
            return
        if self.size == 48:
            if at := self.bytes[byte]:
                self.kids[at - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.bytes[byte] = len(self.kids)
            else:
                kids = [self.kids[at - 1] if at else None for at in self.bytes]
                self.size, self.bytes, self.kids = 256, b"", kids
                self.kids[byte] = node
            return
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.kids[at] = node
        elif len(self.kids) < self.size:
            self.bytes = self.bytes[:at] + bytes([byte]) + self.bytes[at:]
            self.kids.insert(at, node)
        elif self.size == 4:
            self.size = 16
            self.put(byte, node)
        else:
            places = bytearray(256)
            for k, b in enumerate(self.bytes):
                places[b] = k + 1
            self.size, self.bytes = 48, places
            self.put(byte, node)

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None]


def _shared(a: bytes, b: bytes) -> int:
    """How many leading bytes agree."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class RadixTree:
    """Keys with a number each, the least of which and the sums of what comes with it are kept for every node."""

    def __init__(self):
        self.root = Node(b"", None, 0, [0, 0])

    def insert(self, key: bytes, example, low: int, values: tuple[int, int]) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.child(key[at])
            if kid is None:
                node.put(key[at], Node(key[at:], example, low, list(values)))
                return
            same = _shared(kid.path, key[at : at + len(kid.path)])
            if same < len(kid.path):  # the new key leaves inside the path
                upper = Node(kid.path[:same], kid.example, kid.low, list(kid.sums))
                kid.path = kid.path[same:]
                upper.put(kid.path[0], kid)
                node.put(upper.path[0], upper)
                kid = upper
            kid.low = min(kid.low, low)
            kid.sums[0] += values[0]
            kid.sums[1] += values[1]
            node, at = kid, at + same

    def nodes(self) -> Iterator[tuple[int, Node, int]]:
        """``(begin, node, end)``: the bytes of a key before and after each node's path, parents first."""
        stack = [(0, kid) for kid in self.root.children()]
        while stack:
            begin, node = stack.pop()
            end = begin + len(node.path)
            yield begin, node, end
            stack.extend((end, kid) for kid in node.children())


def _step(depth: int, turn: bytes) -> tuple[int, int]:
    """What a turn at a depth adds to the name of a node, as two signed 64-bit integers."""
    d = blake2b(depth.to_bytes(8, "big") + turn, digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _batch(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces ``(conv_id, part, seq, n, ids, words)`` of sorted turns."""
    part, seq = TaskContext.get().partitionId(), 0
    conv, n, ids, words = None, 0, [], []
    names, kinds = "conv_id part seq n ids words", [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column(0).to_numpy()
        flat, w = b"".join(batch.column(1).to_pylist()), batch.column(2).to_numpy().astype("<i4")
        edges = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            while a < b:
                if n and (conv != c[a] or n == PIECE):
                    out.append((conv, part, seq, n, b"".join(ids), b"".join(words)))
                    n, ids, words, seq = 0, [], [], seq + 1
                conv, end = int(c[a]), min(b, a + PIECE - n)
                ids.append(flat[TURN * a : TURN * end])
                words.append(w[a:end].tobytes())
                n, a = n + end - a, end
        yield _batch(out, names, kinds)
    if n:
        yield _batch([(conv, part, seq, n, b"".join(ids), b"".join(words))], names, kinds)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the xor of what a piece's turns add to names."""
    for batch in batches:
        x, y = [], []
        for depth, ids in zip(batch.column("depth").to_pylist(), batch.column("ids").to_pylist()):
            a = b = 0
            for k in range(len(ids) // TURN):
                da, db = _step(depth + k + 1, ids[TURN * k : TURN * k + TURN])
                a, b = a ^ da, b ^ db
            x.append(a)
            y.append(b)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=[*batch.schema.names, "x", "y"])


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Pieces ``(conv_id, depth, a, b, n, ids, words, last, ea, eb)`` of the rebuilt conversations: ``n`` turns below the
    node ``(depth, a, b)``, the last piece of each ending at ``(depth + n, ea, eb)``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(digest, 1, 2 * TURN)).alias("id"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "id"]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "id", "words")
    pieces, _ = keep(rows.mapInArrow(_cut, "conv_id long, part long, seq long, n long, ids binary, words binary"), "pieces")
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns(
        {
            "r": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "total": F.sum("n").over(whole),
            "pieces": F.count("*").over(whole),
            "base": F.col("conv_id") - F.col("conv_id") % every,
            "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most,
        }
    )
    pieces, _ = keep(pieces, "pieces")
    # the first turns of the conversations that others begin with: a few turns each
    first = pieces.where(f"conv_id % {every} = 0 and r < {most - 1}")
    heads = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", "ids", "words"))).alias("found"))
    joined = lambda field, width: F.substring(
        F.aggregate("found", F.lit(b""), lambda all, one: F.concat(all, one[field])), 1, width * (most - 1)
    )
    heads = heads.select(F.col("conv_id").alias("base"), joined("ids", TURN).alias("head_ids"), joined("words", 4).alias("head_words"))
    rows = pieces.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce(F.octet_length("head_ids") / TURN, F.lit(0))).cast("long"))
    new = lambda own, head, width: F.expr(
        f"concat(if(r = 0, coalesce(substring({head}, 1, cast({width} * taken as int)), X''), X''), "
        f"substring({own}, cast({width} * greatest(0, h - r) + 1 as int)))"
    )
    rows = rows.select(
        "conv_id", F.expr("if(r = 0, 0L, taken + greatest(r, h) - h)").alias("depth"), new("ids", "head_ids", TURN).alias("ids"),
        new("words", "head_words", 4).alias("words"), F.expr("taken + greatest(total - h, 0)").alias("whole"), "pieces", "r",
    )
    rows = rows.withColumn("n", (F.octet_length("ids") / TURN).cast("long")).where("n > 0 or r = 0").drop("r")
    named, _ = keep(rows.mapInArrow(_named, f"{_ddl(rows)}, x long, y long"), "pieces")
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    one = named.where("pieces = 1").withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})
    many = named.where("pieces > 1").withColumns({z: F.coalesce(F.bit_xor(x).over(above), F.lit(0).cast("long")) for z, x in (("a", "x"), ("b", "y"))})
    out = one.unionByName(many)
    last = F.col("depth") + F.col("n") == F.col("whole")
    return out.select(
        "conv_id", "depth", "a", "b", "n", "ids", "words", last.alias("last"), F.col("a").bitwiseXOR(F.col("x")).alias("ea"), F.col("b").bitwiseXOR(F.col("y")).alias("eb")
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the nodes of the trees over sorted pieces."""
    names, kinds = "depth a b pa pb low words v1 v2", [pa.int64()] * 9

    def emit(tree: RadixTree) -> Iterator[pa.RecordBatch]:
        out, names_at = [], {}  # the trie node at the last turn's end on each tree node's path
        for begin, node, end in tree.nodes():
            key, words, depth, start = node.example
            at = (begin - _HEAD) // TURN if begin >= _HEAD else -1
            name = names_at.pop(id(node), start)
            if at < 0 and end >= _HEAD:
                at = 0
                if not depth:
                    out.append((0, *start, None, None, node.low, 0, *node.sums))
            for k in range(at + 1, (end - _HEAD) // TURN + 1):
                da, db = _step(depth + k, key[_HEAD + TURN * (k - 1) : _HEAD + TURN * k])
                below = name[0] ^ da, name[1] ^ db
                out.append((depth + k, *below, *name, node.low, words[k - 1], *node.sums))
                name = below
            if end >= _HEAD:
                names_at.update((id(kid), name) for kid in node.children())
            if len(out) > 20000:
                yield _batch(out, names, kinds)
                out = []
        yield _batch(out, names, kinds)

    tree, held = RadixTree(), 0
    for batch in batches:
        for conv, depth, a, b, ids, words, v1, v2 in zip(*(c.to_pylist() for c in batch.columns)):
            key = depth.to_bytes(8, "big") + a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) + ids
            tree.insert(key, (key, np.frombuffer(words, "<i4").tolist(), depth, (a, b)), conv, (v1, v2))
            held += len(key)
            if held >= TREE:
                yield from emit(tree)
                tree, held = RadixTree(), 0
    yield from emit(tree)


def _sums(pieces: DataFrame) -> DataFrame:
    """Every node ``(depth, a, b, pa, pb, low, words, v1, v2)``: its parent, least member, and its members' sums."""
    # the driver sees a sample of what rows are dealt by, so only the first turns of a piece are part of it
    dealt = ["depth", "a", "b", F.substring("ids", 1, 4 * TURN), "conv_id"]
    rows = pieces.select("conv_id", "depth", "a", "b", "ids", "words", "v1", "v2").repartitionByRange(*dealt)
    rows = rows.sortWithinPartitions("depth", "a", "b", "ids", "conv_id")
    parts = rows.mapInArrow(_grow, "depth long, a long, b long, pa long, pb long, low long, words long, v1 long, v2 long")
    return parts.groupBy("depth", "a", "b").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("low").alias("low"), F.max("words").alias("words"),
        F.sum("v1").alias("v1"), F.sum("v2").alias("v2"),
    )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the ids of sorted rows of one node, so that a node where very many end is few rows."""
    names, kinds = "depth a b first ids", [pa.int64()] * 4 + [pa.string()]
    for batch in batches:
        if not batch.num_rows:
            continue
        d, a, b, c = (x.to_numpy() for x in batch.columns)
        new = np.flatnonzero((np.diff(d) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        edges = sorted({0, *new.tolist(), len(d)})
        out = []
        for i, j in zip(edges[:-1], edges[1:]):
            for k in range(i, j, SEGMENT):
                out.append((d[i], a[i], b[i], c[k], ",".join(map(str, c[k : min(j, k + SEGMENT)].tolist()))))
        yield _batch(out, names, kinds)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node, fed segment by segment."""
    names, kinds = "depth a b ends_sha256", [pa.int64()] * 3 + [pa.string()]
    node = digest = None
    for batch in batches:
        out = []
        for *its, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            if its == node:
                digest.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, digest.hexdigest()))
            node, digest = its, sha256(ids.encode())
        yield _batch(out, names, kinds)
    if node:
        yield _batch([(*node, digest.hexdigest())], names, kinds)


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of every node.

    Turns are ordered by ``turn``, null first, turns of one number by the digest of role and text, so repeated rows
    are turns of their own. Each conversation c begins with the first ``crc32(c) % most`` turns of conversation
    ``c - c % every``, where that exists, and goes on with its own turns after as many. A null role or text is empty;
    rows without ``conv_id`` belong to no conversation and are left out. Conversations and prefixes may be of any
    length and shared by any number. Other columns are ignored. An empty table has no nodes, not even a root.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    pieces, _ = keep(rebuilt(conversations, every, most), "pieces")
    nodes, _ = keep(_sums(pieces.withColumns({"v1": F.lit(1).cast("long"), "v2": F.lit(0).cast("long")})).drop("v2"), "nodes")
    on = ["depth", "a", "b"]
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    nodes = nodes.join(kids.agg(F.count("*").alias("n_children")), on, "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("saved", (F.col("v1") - 1) * F.col("words"))
    nodes, _ = keep(nodes.withColumnsRenamed({"v1": "n_convs", "low": "conv_id"}).withColumn("block", F.floor(F.col("depth") / BLOCK)), "nodes")

    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("v1"), F.count_if(F.col("n_children") == 0).alias("v2"))
    sums = _sums(pieces.join(own, "conv_id", "left").fillna(0, ["v1", "v2"])).select(*on, F.col("v1").alias("all_saved"), F.col("v2").alias("n_leaves"))

    ends = pieces.where("last").select((F.col("depth") + F.col("n")).alias("depth"), F.col("ea").alias("a"), F.col("eb").alias("b"), "conv_id")
    order = [*on, "conv_id"]
    segments = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments, "depth long, a long, b long, first long, ids string")
    segments = segments.repartition(*on).sortWithinPartitions(*on, "first")
    ends = segments.mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")

    # what the owner holds above a node: a running sum in blocks of depths, and the sums of the blocks above
    by = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("saved").alias("inside")).withColumn("carried", F.sum("inside").over(by))
    blocks = blocks.where("carried is not null").drop("inside")
    inner = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce("carried", F.lit(0)) + F.coalesce(F.sum("saved").over(inner), F.lit(0))
    out = nodes.join(blocks, ["conv_id", "block"], "left").withColumn("above", above)
    out = out.join(sums, on).join(ends, on, "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, ["depth", "pa", "pb"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all_saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
