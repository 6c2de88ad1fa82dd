"""Operator 1: all pairs of texts whose shingle sets overlap enough, through R-trees over count vectors.

A set is a point: its shingles are hashed into ``DIMENSIONS`` groups and the group counts are its coordinates. Two sets
share at most the sum of the smaller coordinates, and so do a set and any set below a tree node when the node keeps the
largest count of each group. A search visits the nodes whose bound reaches the overlap that the threshold asks for, and
pairs that survive at the leaves are checked on the sets themselves.

One tree over a whole corpus would not prune: counts of unrelated texts of one size lie close together in every single
coordinate. So the upper part of the index is a set of *cells*. The shingles of a size class are hashed into more parts
than two linked sets can have differing shingles, so that linked sets agree on all shingles of at least one part, and
agreeing on a part is an equality, found by one shuffle of the keys, whose number grows with the texts. The least set
of a cell is its centre; the sets that share cells with one centre form a group, every linked pair is in some group, and
each group gets a tree. Large groups are cut into tiles; what a tile could not tie to the centre visits the other tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.common import discard, keep, mix, row_ranges, slices, text_buffer
from lodeline.llm.components import components
from lodeline.llm.words import Hasher, shingle_set

DIMENSIONS = 64
LEAF = 16
FAN = 8
TILE_SETS = 2000
TILE_SHINGLES = 1 << 21
CHECKED = 1 << 18
FOUND_ROWS = 1 << 16
CLASS_RATIO = 1.6


class Threshold:
    """Sets link when ``den * intersection >= num * union``. All bounds are whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes ``a`` and ``b``."""
        return -((-self.num * (a + b)) // (self.den + self.num))

    def apart(self, a: int, b: int) -> int:
        """Most shingles that only one of two linked sets has, for sizes up to these."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest(self, a: int) -> int:
        return a * self.den // self.num

    def smallest(self, a: int) -> int:
        return -(-a * self.num // self.den)


def _class(n: int) -> tuple[int, int, int]:
    """Number, first size and end of the size class of ``n``."""
    low, number = 1, 0
    while True:
        end = max(low + 1, math.ceil(low * CLASS_RATIO))
        if n < end:
            return number, low, end
        low, number = end, number + 1


def signatures(u: np.ndarray, t: Threshold, classes: dict) -> np.ndarray:
    """Keys of the cells of one set: for its own size class, and for smaller ones that its partners can be in.

    A set gives the parts that hold shingles, in order, until it has one more than it can differ in. If a text has
    too few such parts, it gives the empty ones as well.
    """
    n, out = len(u), []
    if n < 1 or t.apart(n, t.largest(n)) < 1:
        return np.zeros(0, np.uint64)  # only equal sets can link
    at = n
    while True:
        if at not in classes:
            classes[at] = _class(at)
        number, low, end = classes[at]
        partner = t.largest(n) if at == n else end - 1
        want = t.apart(n, partner) + 1
        most = t.apart(end - 1, t.largest(end - 1)) + 1
        m = most + 2 + most // 10
        part = (u % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, part, mix(u))
        filled = np.bincount(part, minlength=m) > 0
        chosen = np.flatnonzero(filled)[:want]
        if len(chosen) < want:
            chosen = np.arange(m)
        out.append(mix(sums[chosen] + mix(chosen.astype(np.uint64) + np.uint64(number << 32))))
        if t.smallest(n) >= low or low == 1:
            return np.concatenate(out)
        at = low - 1


class CountTree:
    """R-tree over count vectors, packed bottom-up from an order that halves the points on their widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.array(self._halve(points, np.arange(len(points))), np.int64)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, low, high, step = self.points, self.sizes, self.sizes, LEAF
        while len(top) > 1:
            cuts = np.arange(0, len(top), step)
            top = np.maximum.reduceat(top, cuts)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high, step))
            step = FAN

    def _halve(self, points: np.ndarray, rows: np.ndarray) -> list:
        if len(rows) <= LEAF:
            return rows.tolist()
        own = points[rows]
        rows = rows[np.argsort(own[:, np.argmax(own.max(0) - own.min(0))], kind="stable")]
        half = -(-(len(rows) // 2) // LEAF) * LEAF
        return self._halve(points, rows[:half]) + self._halve(points, rows[half:])

    def search(self, point: np.ndarray, size: int, t: Threshold) -> np.ndarray:
        """Points that may link with this one."""

        def reach(top, low, high):
            bound = np.minimum(top, point).sum(1)
            return (bound >= t.overlap(size, np.maximum(low, t.smallest(size)))) & (high >= t.smallest(size)) & (low <= t.largest(size))

        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for k in range(len(self.levels) - 1, -1, -1):
            top, low, high, step = self.levels[k]
            at = at[reach(top[at], low[at], high[at])]
            below = len(self.points) if k == 0 else len(self.levels[k - 1][0])
            at = (at[:, None] * step + np.arange(step)).reshape(-1)
            at = at[at < below]
        return self.order[at[reach(self.points[at], self.sizes[at], self.sizes[at])]]


def _linked(a: np.ndarray, b: np.ndarray, t: Threshold) -> bool:
    """Exact check; both are sorted and distinct."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) >= t.overlap(len(a), len(b)) if len(a) else False


def join_group(sets: list[np.ndarray], centre: int, asks: np.ndarray, t: Threshold) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that connect all that is connected among these sets, and the rows that are not connected to the centre.

    ``asks`` marks rows that come from another tile: they look for links but need none among themselves.
    """
    n = len(sets)
    parent = np.arange(n)  # the component of each row

    def union(a: int, b: int) -> None:
        parent[parent == parent[b]] = parent[a]

    links = []
    sizes = np.array([len(s) for s in sets])
    points = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=DIMENSIONS) for s in sets])
    if centre >= 0:
        bound = np.minimum(points, points[centre]).sum(1) >= t.overlap(sizes, sizes[centre])
        for i in np.flatnonzero(bound):
            if i != centre and _linked(sets[i], sets[centre], t):
                links.append((centre, int(i)))
                union(centre, i)
    tree = None
    for i in range(n):
        if asks.any() and not asks[i] or centre >= 0 and parent[i] == parent[centre]:
            continue
        if tree is None:
            tree = CountTree(points, sizes)
        for j in tree.search(points[i], int(sizes[i]), t):
            if parent[i] != parent[j] and not (asks[i] and asks[j]) and _linked(sets[i], sets[j], t):
                links.append((i, int(j)))
                union(i, j)
    apart = [] if centre < 0 else np.flatnonzero(parent != parent[centre]).tolist()
    return links, apart


class Tile:
    """Sets side by side, so that one is checked against many at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def own(self, i: int) -> slice:
        return slice(self.ends[i] - self.sizes[i], self.ends[i])

    def linked(self, i: int, some: np.ndarray, t: Threshold) -> np.ndarray:
        """Those of ``some`` that link with ``i``. Exact."""
        n = self.sizes[some]
        self.mark[self.flat[self.own(i)]] = True
        shared = np.zeros(len(some), np.int64)
        step = max(1, CHECKED // max(1, int(n.max(initial=0))))
        for k in range(0, len(some), step):
            m = n[k : k + step]
            starts = np.cumsum(m) - m
            at = np.repeat(self.ends[some[k : k + step]] - m - starts, m) + np.arange(m.sum())
            shared[k : k + step] = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), starts)
        self.mark[self.flat[self.own(i)]] = False
        return some[shared >= t.overlap(n, self.sizes[i])]


class Elsewhere:
    """Which sets of a group are together in a group of a lesser centre too, where their link is counted instead."""

    def __init__(self, centre: int, centres: list[list[int]]):
        lower = [[x for x in some if x < centre] for some in centres]
        self.ends = np.cumsum([len(x) for x in lower])
        self.starts = self.ends - [len(x) for x in lower]
        values, self.flat = np.unique(np.array([x for some in lower for x in some], np.int64), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def here(self, i: int, some: np.ndarray) -> np.ndarray:
        own = self.flat[self.starts[i] : self.ends[i]]
        if not len(own):
            return some
        self.mark[own] = True
        upto = np.concatenate([[0], np.cumsum(self.mark[self.flat])])
        self.mark[own] = False
        return some[upto[self.ends[some]] == upto[self.starts[some]]]


def all_links(
    sets: list[np.ndarray], asks: np.ndarray, elsewhere: Elsewhere, t: Threshold
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set the later ones that link with it, and which of these links are needed to connect what is connected.

    If some sets come from another tile, which ``asks`` marks, they meet the others, and pairs of one kind are left out,
    as are pairs that another group counts.
    """
    inside = np.flatnonzero(~asks)
    if len(sets) < 2 or not len(inside):
        return
    tile, parent = Tile(sets), np.arange(len(sets))
    points = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=DIMENSIONS) for s in sets])
    tree = CountTree(points[inside], tile.sizes[inside])
    across = bool(asks.any())
    for i in np.flatnonzero(asks) if across else range(len(sets)):
        some = inside[tree.search(points[i], int(tile.sizes[i]), t)]
        some = tile.linked(i, elsewhere.here(i, some if across else some[some > i]), t)
        if len(some):
            _, at = np.unique(parent[some], return_index=True)
            ties = np.zeros(len(some), bool)
            ties[at] = parent[some[at]] != parent[i]
            for j in some[ties]:
                parent[parent == parent[j]] = parent[i]
            yield int(i), some, ties


def _sets(docs: DataFrame, size: int, t: Threshold) -> DataFrame:
    """One row per document: id, set size, two hashes that name the set, and the keys of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, classes = Hasher(lower=True), {}
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in row_ranges(offsets):
                w = hasher.words(data, offsets[i : j + 1])
                sets = [shingle_set(w.hash[w.first[k] : w.first[k + 1]], size) for k in range(j - i)]
                keys = [signatures(u, t, classes).view(np.int64) for u in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array([len(u) for u in sets], pa.int64()),
                        pa.array([_name(u) for u in sets], pa.int64()),
                        pa.array([int(np.bitwise_xor.reduce(mix(u + np.uint64(1))).view(np.int64)) for u in sets], pa.int64()),
                        pa.ListArray.from_arrays(
                            np.cumsum([0, *map(len, keys)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *keys])
                        ),
                    ],
                    names=["doc_id", "row", "n", "f", "g", "keys"],
                )

    return docs.mapInArrow(run, "doc_id long, row long, n long, f long, g long, keys array<long>")


def _name(u: np.ndarray) -> int:
    return int(mix(u).sum(dtype=np.uint64).view(np.int64))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and how many each row has."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat, np.diff(column.offsets.to_numpy())


def _candidates(sets: DataFrame) -> DataFrame:
    """``(c, f)``: a set and the least set with which it shares a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole, 1024)):
            # copies of one set have one set of keys, which leaves a task once (or once for each 262,144 other sets)
            fresh = []
            for k, f in enumerate(batch.column(0).to_pylist()):
                if f not in sent:
                    sent.add(f)
                    fresh.append(k)
            if len(sent) > 1 << 18:
                sent = set()
            batch = batch.take(pa.array(fresh, pa.int64()))
            keys, count = _flat(batch.column(1))
            f = np.repeat(batch.column(0).to_numpy(), count)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(f)], names=["key", "f"])

    shared = sets.where(F.size("keys") > 0).select("f", "keys").mapInArrow(run, "key long, f long")
    least = F.min("f").over(Window.partitionBy("key"))
    return shared.withColumn("c", least).where("f <> c").select("c", "f").distinct()


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple, list, list[int], list[bool], list]]:
    """The key, sets, names, marks of those that ask and further columns, for each group ``(c, tile, part)`` of sorted rows."""
    hasher = Hasher(lower=True)

    def parsed(key: tuple, rows: list) -> tuple[tuple, list, list[int], list[bool], list]:
        data, offsets = text_buffer(pa.array([r[2] for r in rows], pa.large_string()))
        w = hasher.words(data, offsets)
        sets, names, asks, more, had = [], [], [], [], set()
        for k, (f, ask, _, *others) in enumerate(rows):
            u = shingle_set(w.hash[w.first[k] : w.first[k + 1]], size)
            if _name(u) == f and (f, ask) not in had:  # an id may stand for several texts
                had.add((f, ask))
                sets.append(u)
                names.append(f)
                asks.append(ask)
                more.append(others)
        return key, sets, names, asks, more

    key, held = None, []
    for batch in (part for whole in batches for part in slices(whole)):
        for c, tile, part, *row in zip(*(x.to_pylist() for x in batch.columns)):
            if (c, tile, part) != key:
                if held:
                    yield parsed(key, held)
                key, held = (c, tile, part), []
            held.append(row)
    if held:
        yield parsed(key, held)


def _grouped(members: DataFrame) -> DataFrame:
    group = ["c", "tile", "part"]
    return members.select(*group, "f", "asks", "text", *(x for x in ("copies", "centres") if x in members.columns)).repartition(*group).sortWithinPartitions(*group)


def _links(members: DataFrame, size: int, t: Threshold) -> DataFrame:
    """Searches each group ``(c, tile, part)`` of ``members(c, tile, part, f, asks, text, copies)``. Rows ``(c, a, b)``: a link, or
    with null ``b`` a set that its tile does not connect to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (c, _, _), sets, names, asks, _ in _groups(batches, size):
            if len(sets) < 2:
                continue
            centre = names.index(c) if c in names and not any(asks) else -1
            links, apart = join_group(sets, centre, np.array(asks), t)
            out += [(c, names[i], names[j]) for i, j in links] + [(c, names[i], None) for i in apart]
            if len(out) > 10000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return _grouped(members).mapInArrow(run, "c long, a long, b long")


def _every_link(members: DataFrame, size: int, t: Threshold, listed: bool) -> DataFrame:
    """``(a, b, k, tie)``, from ``members`` with the numbers of their copies and their centres. With null ``b``: a set and how
    many rows it links with. Else a link, ``a < b``, once: those that connect the group, or all if they are ``listed``."""
    names_of = ["a", "b", "k", "tie"]

    def batch(out: list) -> pa.RecordBatch:
        a, b, k, tie = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        columns = [pa.array(a), pa.array(b, mask=k > 0), pa.array(k), pa.array(tie)]
        return pa.RecordBatch.from_arrays(columns, names=names_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for (c, _, part), sets, names, asks, more in _groups(batches, size):
            if part >= 0 and not any(asks):
                continue  # the tile meets itself elsewhere
            f, copies = np.array(names, np.int64), np.array([x[0] for x in more], np.int64)
            others = np.zeros(len(f), np.int64)
            for i, some, ties in all_links(sets, np.array(asks, bool), Elsewhere(c, [x[1] for x in more]), t):
                others[i] += copies[some].sum()
                others[some] += copies[i]
                if not listed:
                    some, ties = some[ties], ties[ties]
                out.append((np.minimum(f[i], f[some]), np.maximum(f[i], f[some]), np.zeros(len(some), np.int64), ties))
                held += len(some)
                if held > FOUND_ROWS:
                    yield batch(out)
                    out, held = [], 0
            linked = others > 0
            out.append((f[linked], f[linked], others[linked], np.zeros(linked.sum(), bool)))
            held += len(out[-1][0])
        yield batch(out)

    return _grouped(members).mapInArrow(run, "a long, b long, k long, tie boolean")


def _edges(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["c", "a", "b"])


def jaccard_components(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    ``n_shingles`` counts the distinct runs of ``size`` words of the whole text, A-Z lower-cased; a shorter text is one
    run. Texts link when ``den * intersection >= num * union``; ``component_id`` is the smallest id that links reach.
    A null or empty text, or one without words, has no shingles and is its own component. Equal sets link as one. Rows
    that repeat an id are kept, each with the component of its own text. A row without id links like any other and takes
    the smallest id that its links reach, else null. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    t = Threshold(num, den)
    index = _Index(docs, id, text, size, t)
    spark, rows, spread = docs.sparkSession, index.rows, index.spread
    rows = rows.union(spread.select("c", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), F.col("c").alias("f")))
    members = index.with_texts(rows.withColumns({"part": F.lit(0), "asks": F.lit(False)}))
    found, found_path = keep(_links(members, size, t), "found")

    links = found.where("b is not null").select("a", "b")
    open_rows = found.where("b is null").select("c", F.col("a").alias("f")).distinct()
    again, again_path = keep(open_rows.join(spread.where("tiles > 1"), "c"), "open")
    paths = [*index.paths, found_path, again_path]
    if again.limit(1).count():  # sets that their tile did not tie to the centre ask the other tiles
        # as many at a time as a tile has sets; each part meets the whole tile, so memory is bounded however many ask
        parts = index.pieces(again).withColumnRenamed("tiles", "parts")
        asking = again.join(parts, "c").select(
            "c", F.explode(F.expr("filter(sequence(0, tiles - 1), x -> x <> pmod(xxhash64(f), tiles))")).alias("tile"),
            F.expr("pmod(xxhash64(f, 1), parts)").cast("int").alias("part"), "f", F.lit(True).alias("asks"),
        )
        asked = rows.join(parts, "c").select("c", "tile", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "f", F.lit(False).alias("asks"))
        members = index.with_texts(asked.union(asking))
        more, more_path = keep(_links(members, size, t), "found")
        links = links.union(more.where("b is not null").select("a", "b"))
        paths.append(more_path)

    joined, _ = keep(index.components(links), "components")
    result = index.members(joined).select("doc_id", "n_shingles", "component_id")
    for path in paths:
        discard(spark, path)
    return result


def jaccard_join(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100, listed: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """All links: ``members(doc_id, n_shingles, component_id, n_links, set)``, a row for every row of ``docs``, and
    ``links(a, b)``, a row for every two different sets that link, ``a < b``.

    The first three columns are those of :func:`jaccard_components`, with its rules for nulls, empty texts, repeated ids
    and clashing names. ``n_links`` is the number of other rows that a row's text links with, equal texts among them.
    ``set`` names a text's set in ``links``; a text without shingles has none and no links. A group of texts that all
    link has as many links as pairs of different sets, and its search grows with them; unless they are ``listed``, links are
    counted in the tasks that find them, and no table of them is made.
    """
    t = Threshold(num, den)
    index = _Index(docs, id, text, size, t)
    spread = index.spread
    # each set meets its own tile, and as one that asks every later tile of its group, in parts of a tile's size
    rows = index.rows.union(spread.select("c", F.expr("pmod(xxhash64(c), tiles)").cast("int").alias("tile"), F.col("c").alias("f")))
    alone = rows.withColumns({"part": F.lit(-1), "asks": F.lit(False)})
    tiled = rows.join(spread.where("tiles > 1"), "c")
    asking = tiled.where("tile + 1 < tiles").select(
        "c", F.explode(F.expr("sequence(tile + 1, tiles - 1)")).alias("tile"),
        "f", F.expr("pmod(xxhash64(f, 1), tiles)").cast("int").alias("part"), F.lit(True).alias("asks"),
    )
    asked = tiled.where("tile > 0").select("c", "tile", "f", F.explode(F.expr("sequence(0, tiles - 1)")).alias("part"), F.lit(False).alias("asks"))
    # a pair is counted where its least centre is; a set has no more centres than its text has cells
    centres = rows.groupBy("f").agg(F.collect_set("c").alias("centres"))
    met = alone.unionByName(asking).unionByName(asked).join(centres, "f")
    found, found_path = keep(_every_link(index.with_texts(met), size, t, listed), "links")
    others = found.where("b is null").groupBy(F.col("a").alias("f")).agg(F.sum("k").alias("others"))
    tied = index.components(found.where("b is not null and tie").select("a", "b"))
    joined, _ = keep(others.join(tied, "f"), "components")
    members = index.members(joined).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.coalesce("others", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.expr("if(n_shingles > 0, f, null)").alias("set"),
    )
    for path in index.paths if listed else [*index.paths, found_path]:
        discard(docs.sparkSession, path)
    return members, found.where("b is not null").select("a", "b") if listed else None


class _Index:
    """The sets of a table and the groups that may hold links, each written to the shared folder."""

    def __init__(self, docs: DataFrame, id: str, text: str, size: int, t: Threshold):
        docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        # a set's text is found by id and text, since ids may be null or stand for several texts
        docs = docs.withColumn("row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
        texts = docs.where("doc_id is not null").union(docs.where("doc_id is null").dropDuplicates(["row"]))
        self.texts = texts.select("row", "text")
        self.sets, _ = keep(_sets(docs, size, t), "sets")
        # written, so that joins with it shuffle both sides and Spark can split a set that very many documents have
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
        first = self.sets.where("n > 0").groupBy("n", "f", "g").agg(least.alias("least"), F.count("*").alias("copies"))
        self.first, _ = keep(first.select("n", "f", "g", F.col("least.doc_id").alias("first"), "least.row", "copies"), "first")
        self.star, star_path = keep(_candidates(self.sets), "candidates")
        self.n_of = self.sets.groupBy("f").agg(F.max("n").alias("n"))
        self.spread, spread_path = keep(self.pieces(self.star), "groups")
        self.paths = [star_path, spread_path]  # the result reads the others
        self.rows = self.star.join(self.spread, "c").select("c", F.expr("pmod(xxhash64(f), tiles)").cast("int").alias("tile"), "f")
        self.names = self.first.select("f", F.col("first").alias("doc_id"), "row", "copies")

    def pieces(self, some: DataFrame) -> DataFrame:
        """``(c, tiles)``: how many tiles the sets of each group need."""
        weighed = some.join(self.n_of, "f").groupBy("c").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
        tiles = F.greatest(F.ceil(F.col("k") / TILE_SETS), F.ceil(F.col("w") / TILE_SHINGLES))
        return weighed.select("c", tiles.cast("int").alias("tiles"))

    def with_texts(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.names, "f").join(self.texts, "row")

    def components(self, links: DataFrame) -> DataFrame:
        """``(f, component_id)`` of sets with links."""
        of = components(links)
        named = of.join(self.names, of.node == self.names.f).groupBy("component").agg(F.min("doc_id").alias("component_id"))
        return of.join(named, "component").select(F.col("node").alias("f"), "component_id")

    def members(self, joined: DataFrame) -> DataFrame:
        """The rows of the table, with what is known of their sets."""
        head = self.sets.select("doc_id", "n", "f", "g")
        out = head.join(self.first.hint("merge"), ["n", "f", "g"], "left").join(joined, "f", "left")
        return out.withColumnRenamed("n", "n_shingles").withColumn("component_id", F.coalesce("component_id", "first", "doc_id"))
