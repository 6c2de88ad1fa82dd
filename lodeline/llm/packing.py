"""Operator 11: packing documents into windows with the neighbours that a BM25 index finds for them.

Texts are encoded once and written. Documents are dealt by ranges of a min-hash of their pairs of ids, so copies and
texts that share phrases come together, and each task works through its range in shards of bounded size. A shard is an
inverted index over the ids of whole documents, weighted by BM25 with the document frequencies and the mean length of
the whole corpus. The next document in order opens a window; the index is asked with its rarest ids, and unused
neighbours fill the window, best first, those that fit whole before one that is cut. What is left of the cut one opens
the next window. The last window of a shard is cut into lengths that are powers of two, so nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import keep, row_ranges, text_buffer
from lodeline.llm.tokens import PIECE, Encoder, load

#: A shard ends at so many ids or documents; a longer document is a shard of its own.
SHARD_IDS, SHARD_DOCS = 1 << 20, 2048
#: Ids of a document that ask the index, the rarest in the corpus.
ASKED = 32
#: The usual parameters of BM25.
K1, B = 1.2, 0.75


class Corpus:
    """What all shards share: the number of documents that hold each id, and the mean length."""

    def __init__(self, holders: np.ndarray, docs: int, ids: int):
        self.idf = np.log1p((docs - holders + 0.5) / (holders + 0.5))
        self.mean = max(1.0, ids / max(1, docs))
        self.rarity = np.empty(len(holders), np.int64)  # a place for each id, rarest first
        self.rarity[np.lexsort((np.arange(len(holders)), -self.idf))] = np.arange(len(holders))


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's ids in order, and how often it holds each."""
    s, new = _ordered(ids)
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s)))


def _ordered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids, and which of them differ from the one before."""
    s = np.sort(ids, kind="stable")  # of 16-bit integers, by radix
    new = np.empty(len(s), bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s, new


class Shard:
    """An inverted index: for each id, the documents that hold it and what it adds to their scores."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        self.docs, self.corpus = docs, corpus
        parts = [distinct(d) for d in docs]
        self.terms = [t for t, _ in parts]
        sizes = [len(t) for t in self.terms]
        term, count = np.concatenate(self.terms).astype(np.int64), np.concatenate([n for _, n in parts])
        doc = np.repeat(np.arange(len(docs)), sizes)
        norm = K1 * (1 - B + B * np.array(list(map(len, docs))) / corpus.mean)
        weight = corpus.idf[term] * count * (K1 + 1) / (count + norm[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(corpus.idf)))])

    def scores(self, k: int) -> np.ndarray:
        """BM25 of every document for the rarest ids of document ``k``."""
        terms = self.terms[k].astype(np.int64)
        if len(terms) > ASKED:
            terms = terms[np.argpartition(self.corpus.rarity[terms], ASKED)[:ASKED]]
        terms.sort()
        spans = [slice(a, b) for a, b in zip(self.ends[terms].tolist(), self.ends[terms + 1].tolist())]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.docs))

    def windows(self, size: int) -> Iterator[list[tuple[int, int, int]]]:
        """Windows as lists of ``(document, begin, length)``. All are full, but the last may be shorter."""
        left = np.array(list(map(len, self.docs)))
        whole, follows, opened = left.copy(), 0, -1
        while True:
            if opened < 0:  # the next document in order
                while follows < len(left) and not left[follows]:
                    follows += 1
                if follows == len(left):
                    return
                opened = follows
            seed, opened = opened, -1
            while left[seed] >= size:
                yield [(seed, int(whole[seed] - left[seed]), size)]
                left[seed] -= size
            if not left[seed]:
                continue
            window, space = [(seed, int(whole[seed] - left[seed]), int(left[seed]))], size - int(left[seed])
            left[seed] = 0
            score = self.scores(seed)
            near = np.flatnonzero((score > 0) & (left > 0))
            near = near[np.argsort(-score[near], kind="stable")]
            while True:  # neighbours that fit whole, best first
                fit = np.flatnonzero(left[near] <= space)
                if not len(fit):
                    break
                k = int(near[fit[0]])
                window.append((k, int(whole[k] - left[k]), int(left[k])))
                space, left[k], near = space - int(left[k]), 0, near[fit[0] + 1 :] if not fit[0] else np.delete(near, fit[0])
            while space:  # the best of the others is cut; without neighbours, the next in order
                while follows < len(left) and not left[follows]:
                    follows += 1
                if not len(near) and follows == len(left):
                    break
                k = int(near[0]) if len(near) else follows
                near = near[1:]
                n = min(space, int(left[k]))
                window.append((k, int(whole[k] - left[k]), n))
                space, left[k] = space - n, left[k] - n
                if left[k]:
                    opened = k
            yield window


def _powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A window cut into lengths that are powers of two, the longest first."""
    n = sum(p[2] for p in window)
    window = window[::-1]
    while n:
        want = 1 << (n.bit_length() - 1)
        n, out = n - want, []
        while want:
            k, begin, length = window.pop()
            if length > want:
                window.append((k, begin + want, length - want))
                length = want
            out.append((k, begin, length))
            want -= length
        yield out


def _keys(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least hash of a pair of ids that follow each other, for each row; rows have an id at least."""
    wide = ids.astype(np.uint64)
    pairs = np.empty(len(ids), np.uint64)
    pairs[:-1] = ((wide[:-1] << np.uint64(32)) + wide[1:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    pairs ^= pairs >> np.uint64(32)  # high bits depend on all of a product's factors, low ones do not
    pairs *= np.uint64(0xD6E8FEB86659FD93)
    pairs[bounds[1:] - 1] = np.uint64((1 << 64) - 1)  # the last id of a row begins no pair
    return np.minimum.reduceat(pairs, bounds[:-1]).view(np.int64)


def encode(docs: DataFrame, content: bytes, end_id: int, id: str, text: str) -> DataFrame:
    """``(kind, doc_id, key, n, ids)`` of every text (kind 0), and from each task how many of its documents hold each id
    (kind 1, as 64-bit integers; ``n`` counts its ids and ``key`` its documents)."""
    size = load(content)[0].get_vocab_size(True)
    size, width = max(size, end_id + 1), 2 if max(size, end_id + 1) <= 1 << 16 else 4
    file = docs.sparkSession.sparkContext.broadcast(content)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, holders, rows, total = None, np.zeros(size, np.int64), 0, 0
        for batch in batches:
            encoder = encoder or Encoder(file.value, width)
            _, offsets = text_buffer(batch.column(1))
            for i, j in row_ranges(offsets, PIECE):
                ids, bounds = encoder.encode(batch.column(1).slice(i, j - i))
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    s, new = _ordered(ids[a:b])
                    holders[s[new]] += 1
                rows, total = rows + j - i, total + len(ids)
                flat = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * (j - i), pa.int32()), batch.column(0).slice(i, j - i), pa.array(_keys(ids, bounds)),
                     pa.array(np.diff(bounds)), pa.array(flat, pa.binary())], names=names,
                )
                doc_kind = batch.column(0).type
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), pa.nulls(1, doc_kind), pa.array([rows]), pa.array([total]), pa.array([holders.tobytes()], pa.binary())],
                names=names,
            )

    names = ["kind", "doc_id", "key", "n", "ids"]
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"kind int, doc_id {kind}, key long, n long, ids binary")


def corpus_counts(encoded: DataFrame, size: int) -> Corpus:
    """Sums the counts of all tasks: one row per id of the vocabulary reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += np.frombuffer(held.as_buffer(), np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})

    counts = encoded.where("kind = 1")
    holders = np.zeros(size, np.int64)
    for row in counts.select("ids").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        holders[row.id] = row.n
    docs, ids = counts.agg(F.sum("key"), F.sum("n")).first()
    return Corpus(holders, docs or 0, ids or 0)


def pack(
    docs: DataFrame, content: bytes, end_id: int = 0, size: int = 1024, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of every piece; ``ids`` are unsigned 32-bit
    integers, little-endian.

    A document is the ids of its whole text and ``end_id``; a null or empty text is the end id alone. Every id lies in
    one piece. Sequences have ``size`` ids, but for a few of each shard that have a power of two. Rows that repeat an
    id, or have none, are documents of their own; equal rows pack alike and lie side by side. Long texts are cut into
    full windows first. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocabulary = max(load(content)[0].get_vocab_size(True), end_id + 1)
    width = 2 if vocabulary <= 1 << 16 else 4
    encoded, _ = keep(encode(docs, content, end_id, id, text), "encoded")
    corpus = corpus_counts(encoded, vocabulary)
    counts = spark.sparkContext.broadcast((corpus.idf, corpus.mean, corpus.rarity))
    # the driver sees a sample of what rows are dealt by, so their ids are not part of it
    order = ["key", F.asc_nulls_first("doc_id"), "n", "tie"]
    rows = encoded.where("kind = 0").select("doc_id", "key", "n", "ids", F.xxhash64("ids").alias("tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Corpus.__new__(Corpus)
        shared.idf, shared.mean, shared.rarity = counts.value
        sequence, held, names, n = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out = []
            for window in Shard(held, shared).windows(size):
                full = sum(p[2] for p in window) == size
                for part in [window] if full else _powers(window):
                    offset = 0
                    for k, begin, length in part:
                        out.append((k, begin, length, held[k][begin : begin + length].astype("<u4").tobytes(), len(held[k]), sequence, offset))
                        offset += length
                    sequence += 1
                if len(out) >= 2000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

        def table(out: list[tuple]) -> pa.RecordBatch:
            which, *columns = zip(*out)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            ids = pa.array([names[k] for k in which], doc_kind)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=columns_)

        for batch in batches:
            doc_kind = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for name, ids in zip(some.column(0).to_pylist(), some.column(3)):
                    ids = np.frombuffer(ids.as_buffer(), f"<u{width}")
                    if held and (n + len(ids) > SHARD_IDS or len(held) == SHARD_DOCS):
                        yield from flush()
                        held.clear()
                        names.clear()
                        n = 0
                    held.append(ids)
                    names.append(name)
                    n += len(ids)
        if held:
            yield from flush()

    columns_ = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
