"""Operator 3: documents that hold a benchmark item, word for word or with some words changed.

The CGK embedding reads a sequence of words by a random walk: at each step it copies the current word, and a random bit
of step and word says whether to move on. Sequences a few edits apart fall into step again, so edit distance becomes
Hamming distance. Hamming distance is searched by sampling a few places of the walk as a key, again and again. Items
are indexed from each of their words, documents are read at windows of a fixed stride, so some windows of an item's copy
begin at the same word as an indexed one whatever lies before it. Windows follow the items: each class of lengths,
from the shortest item to twice its length and so on, has windows of half its least length and a stride of a quarter.

Walks alone lose copies with many words changed, above all of long items. So each item is also cut into one piece more
than words of it may change: whatever the changes, one piece stays as it was, and documents are searched for the pieces at
every word. Pairs that share a key or a piece are checked exactly by edit distance, so no pair within the limit is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import mix, random_words, row_ranges, share, shared, text_buffer
from lodeline.llm.words import MARKS, Hasher, windows

SIMILAR = 0.8
LEAST_WORDS = 5  # of items that walks look for; of a shorter one no word may change, so its run of words is its only piece
WALKS = 4
TABLES = 3  # of each walk
PLACES = 4  # of each table
BLOCK = 20_000  # items that one pass over the documents looks for
LONGEST_RUN = 8  # words of a piece that are compared; more would only make rare ones rarer
_FILTER = 22
_PART = 1 << 18  # candidates at a time


class Walk:
    """The embeddings of one length class: ``window`` words, read in one and a half times as many steps."""

    def __init__(self, low: int):
        self.low, self.stride, self.window = low, max(1, low // 4), low // 2 + 1
        self.steps = min(64, self.window * 3 // 2)
        rng = np.random.default_rng(low)
        # one place in each stretch of the walk, so that a key is of as many different words as can be
        cuts = np.linspace(0, self.steps, PLACES + 1).astype(int)
        stretch = [(a, max(a + 1, b)) for a, b in zip(cuts, cuts[1:])]
        self.places = [[{int(rng.integers(a, b)) for a, b in stretch} for _ in range(TABLES)] for _ in range(WALKS)]
        self.seeds = random_words(WALKS, low)
        self.names = random_words(WALKS * TABLES, low + 1)

    def keys(self, h: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The keys of each table for the windows at ``starts``; words that a walk reaches beyond the end are 0."""
        for w in range(WALKS):
            own = np.concatenate([mix(h + self.seeds[w]), np.zeros(self.steps + 1, np.uint64)])
            at, keys = starts.copy(), [np.full(len(starts), self.names[w * TABLES + t]) for t in range(TABLES)]
            for step in range(max(max(p) for p in self.places[w]) + 1):
                word = own[at]
                for t, places in enumerate(self.places[w]):
                    if step in places:
                        keys[t] = keys[t] * np.uint64(0x2127599BF4325C37) + word
                at += ((word >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
            for k in keys:
                yield mix(k)


class Table:
    """Places in items, by key."""

    def __init__(self, keys: list[np.ndarray], which: list[np.ndarray], shift: list[np.ndarray]):
        keys, which, shift = map(np.concatenate, (keys, which, shift))
        order = np.argsort(keys, kind="stable")
        self.keys, self.which, self.shift = keys[order], which[order], shift[order]
        self.seen = np.zeros(1 << _FILTER, bool)
        self.seen[(keys >> np.uint64(64 - _FILTER)).astype(np.int64)] = True

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the keys are here, and between which places of the table."""
        hit = np.flatnonzero(self.seen[(found >> np.uint64(64 - _FILTER)).astype(np.int64)])
        a, b = np.searchsorted(self.keys, found[hit], "left"), np.searchsorted(self.keys, found[hit], "right")
        return hit[b > a], a[b > a], b[b > a]

    def pairs(self, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        """Rows ``(item, word where its copy would begin, word where it was seen)``, a bounded number at a time."""
        i, ends = 0, np.cumsum(b - a)
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - (b[i] - a[i]) + _PART, "right")))
            n = b[i:j] - a[i:j]
            at = np.repeat(a[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())
            seen = np.repeat(starts[i:j], n)
            yield np.stack([self.which[at], seen - self.shift[at], seen], 1)
            i = j


class Index:
    """Windows of the items of all length classes by key, and the pieces of the items."""

    def __init__(self, items: list[tuple[int, str]], similar: float = SIMILAR):
        hasher = Hasher(lower=True, separators=MARKS, unspaced=True)
        data, offsets = text_buffer(pa.array([t or "" for _, t in items], pa.large_string()))
        w = hasher.words(data, offsets)
        self.ids = [i for i, _ in items]
        self.items = [w.hash[w.first[k] : w.first[k + 1]] for k in range(len(items))]
        self.classes = []
        sizes = np.array([len(x) for x in self.items])
        left = np.sort(sizes[sizes >= LEAST_WORDS])
        while len(left):
            low = int(left[0])
            self.classes.append(self._class(Walk(low), np.flatnonzero((sizes >= low) & (sizes < 2 * low))))
            left = left[left >= 2 * low]

        self.runs = self._runs(similar)

    def _class(self, walk: Walk, own: np.ndarray) -> tuple[Walk, Table]:
        keys, which, shift = [], [], []
        for k in own:
            starts = np.arange(len(self.items[k]) - walk.window + 1)
            for found in walk.keys(self.items[k], starts):
                keys.append(found)
                which.append(np.full(len(starts), k))
                shift.append(starts)
        return walk, Table(keys, which, shift)

    def _runs(self, similar: float) -> list[tuple[int, Table]]:
        """The first words of the pieces of each item, by how many words these are."""
        of: dict[int, tuple[list, list, list]] = {}
        for k, words in enumerate(self.items):
            if not len(words):
                continue
            pieces = allowed(len(words), similar) + 1
            size = min(LONGEST_RUN, len(words) // pieces)
            starts = np.arange(pieces) * len(words) // pieces
            for column, x in zip(of.setdefault(size, ([], [], [])), (windows(words, size)[starts], np.full(pieces, k), starts)):
                column.append(x)
        return [(size, Table(*columns)) for size, columns in sorted(of.items())]

    def candidates(self, h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """Rows ``(item, word where its copy would begin, word where it was seen)`` in the rows between ``first``."""
        for walk, table in self.classes:
            n = np.maximum(0, (np.diff(first) - walk.window) // walk.stride + 1)
            ahead = np.concatenate([[0], np.cumsum(n)])
            starts = (np.arange(ahead[-1]) - np.repeat(ahead[:-1], n)) * walk.stride + np.repeat(first[:-1], n)
            for found in walk.keys(h, starts):
                hit, a, b = table.find(found)
                yield from table.pairs(starts[hit], a, b)
        for size, table in self.runs:
            hit, a, b = table.find(windows(h, size))
            inside = hit + size <= first[np.searchsorted(first, hit, "right")]
            yield from table.pairs(hit[inside], a[inside], b[inside])


def allowed(n: int, similar: float = SIMILAR) -> int:
    """Most words that a copy of ``n`` words may have changed, put in or left out."""
    return int(n * (1 - similar) + 1e-9)


def least_edits(item: np.ndarray, text: np.ndarray) -> int:
    """Word edit distance between the item and the stretch of ``text`` nearest to it (bit-parallel, one step per word)."""
    n = len(item)
    where: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, cost, best = full, 0, n, n
    for x in text.tolist():
        eq = where.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        cost += bool(plus & top) - bool(minus & top)
        best = min(best, cost)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
    return best


def find_items(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    similar: float = SIMILAR, block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, item_id, edits, item_words)``: documents that hold an item, with the fewest edits found.

    Words are runs of letters and digits, A-Z lower-cased, and single characters of scripts that put no space between
    words; every document is read whole. A document holds an item if some
    stretch of it becomes the item by at most ``(1 - similar) * item words`` words changed, put in or left out, so a short
    item only by none. Null items and those without words are never found; neither is anything in a null or empty text.
    Rows that repeat an id give one row for each item; so do items that repeat an id. Empty tables give an empty result. Items are
    looked for in blocks of ``block``, one pass over the documents each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    kind = "doc_id long, item_id long, edits long, item_words long"
    found = spark.createDataFrame([], kind)
    for some in batched(rows.toLocalIterator(), block):
        index = share(spark, Index([tuple(r) for r in some], similar))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hasher, index = Hasher(lower=True, separators=MARKS, unspaced=True), shared(index)
            own = lru_cache(1 << 12)(lambda item: frozenset(index.items[item].tolist()))
            for batch in batches:
                data, offsets = text_buffer(batch.column(1))
                for i, j in row_ranges(offsets):
                    w = hasher.words(data, offsets[i : j + 1])
                    best: dict[tuple[int, int], int] = {}
                    done: set[tuple[int, int, int]] = set()
                    for part in index.candidates(w.hash, w.first):
                        if len(done) > _PART:
                            done = set()
                        rows = np.searchsorted(w.first, part[:, 2], "right") - 1
                        for row, item, begin in zip(rows.tolist(), part[:, 0].tolist(), part[:, 1].tolist()):
                            if (row, item, begin) in done or best.get((row, item)) == 0:
                                continue
                            done.add((row, item, begin))
                            words = index.items[item]
                            k = allowed(len(words), similar)
                            # an exact copy begins right there; another at most as many words off as it has edits
                            a, b = max(int(w.first[row]), begin - k), min(int(w.first[row + 1]), begin + len(words) + k)
                            if len(own(item).difference(w.hash[a:b].tolist())) > k:
                                continue  # each word that is not there is an edit
                            edits = least_edits(words, w.hash[a:b])
                            if edits <= k:
                                best[row, item] = min(edits, best.get((row, item), edits))
                    ids = batch.column(0).slice(i, j - i).to_pylist()
                    out = [(ids[row], index.ids[item], n, len(index.items[item])) for (row, item), n in best.items()]
                    columns = list(zip(*out)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "item_id", "edits", "item_words"])

        found = found.union(docs.mapInArrow(run, kind))
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("item_words").alias("item_words"))
