"""Operator 12: importance resampling towards a target distribution by hashed n-gram features.

The tokenizers library splits ASCII-lowered texts by a pattern and returns words with their offsets; nothing is trained.
Runs of one to three words, joined by one space, are features, and a feature's bucket is the CRC of its bytes. Checksums
are linear, so the one of a run follows from those of its words by shifts of whole arrays: no Python code runs per
feature. Every text is split once; its buckets are written, then counted for the histograms and summed for the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import keep, numbered, row_ranges, text_buffer, worker_store

#: What separates words, all of ASCII but letters and digits (of lower-cased text).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUNS = 3
#: Bytes of text that are split at a time; a longer text is cut at separators and its runs go on across the cuts.
PIECE = 1 << 20
#: Bytes of one call of the library, whose time for a byte grows with them.
CALL = 1 << 11
_SHORT = 64
_ONES = 0xFFFFFFFF
_offsets = itemgetter(1)


class Checksums:
    """CRC-32 of runs of words from the words' own registers: ``r(ab)`` is ``r(a)`` moved on by the length of ``b``, xor ``r(b)``."""

    def __init__(self):
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
        self.table = table
        basis = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        moves = [basis]
        for _ in range(_SHORT):
            moves.append(self._byte(moves[-1], np.uint8(0)))
        self.short = np.stack(moves)  # moves by 0 to 64 bytes, for each byte of a register
        self.space = int(self._byte(np.zeros(1, np.uint32), np.uint8(0x20))[0])
        self.double = [self.short[1]]  # moves by 2 ** k bytes

    def _byte(self, register: np.ndarray, byte) -> np.ndarray:
        return (register >> np.uint32(8)) ^ self.table[(register ^ byte) & np.uint32(255)]

    def _apply(self, move: np.ndarray, register: np.ndarray) -> np.ndarray:
        out = np.zeros_like(register)
        for k in range(4):
            out ^= move[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def move(self, register: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Registers after ``n`` more zero bytes each."""
        low = np.minimum(n, _SHORT) * 1024
        flat, out = self.short.reshape(-1), np.zeros_like(register)
        for k in range(4):
            out ^= flat[low + 256 * k + ((register >> np.uint32(8 * k)) & np.uint32(255))]
        far = np.flatnonzero(n > _SHORT)
        rest, bit = n[far] - _SHORT, 0
        while len(far) and (rest >> bit).any():
            while len(self.double) <= bit:
                self.double.append(self._apply(self.double[-1], self.double[-1]))
            some = far[(rest >> bit) & 1 == 1]
            out[some] = self._apply(self.double[bit], out[some])
            bit += 1
        return out

    def words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Registers of words, all from 0, a byte of each word at a time."""
        order = np.argsort(-np.minimum(size, _SHORT + 1).astype(np.int8), kind="stable")
        at, n = start[order], size[order]
        counts = np.cumsum(np.bincount(np.minimum(n, _SHORT + 1), minlength=_SHORT + 2)[::-1])[::-1]
        register = np.zeros(len(n), np.uint32)
        longer = int(counts[_SHORT + 1])
        for k in range(_SHORT):
            m = int(counts[k + 1])
            if m == longer:
                break
            register[longer:m] = self._byte(register[longer:m], data[at[longer:m] + k])
        for k in range(longer):
            register[k] = zlib.crc32(data[at[k] : at[k] + n[k]].tobytes(), _ONES) ^ _ONES
        out = np.empty_like(register)
        out[order] = register
        return out

    def runs(self, register: np.ndarray, size: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2 ... words: the checksums of runs that begin at each word, and which of them stay inside a text.

        ``last[i]`` is the place behind the text of word ``i``.
        """
        at, now, length = np.arange(len(size)), register, size
        for k in range(RUNS):
            if k:
                m = len(size) - k
                if m <= 0:
                    return
                head = self.move(now[:m], np.ones(m, np.int64)) ^ np.uint32(self.space)
                now = self.move(head, size[k:]) ^ register[k:]
                length = length[:m] + 1 + size[k:]
            ones = np.full(len(now), _ONES, np.uint32)
            yield self.move(ones, length) ^ now ^ np.uint32(_ONES), at[: len(now)] + k < last[: len(now)]


def _splitter():
    from tokenizers import Regex, pre_tokenizers

    store = worker_store()
    if "words" not in store:
        store["words"] = pre_tokenizers.Split(Regex(SEPARATORS), "removed")
    return store["words"]


def _words(split, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and how long they are, in bytes: each byte is shown to the library as one character."""
    parts = [np.zeros(0, np.int64)]
    cuts = _cuts(np.frombuffer(data, np.uint8), 0, len(data), CALL)
    for a, b in zip(cuts[:-1], cuts[1:]):
        found = split.pre_tokenize_str(data[a:b].decode("latin-1"))
        parts.append(np.fromiter(chain.from_iterable(map(_offsets, found)), np.int64, 2 * len(found)) + a)
    edges = np.concatenate(parts).reshape(-1, 2)
    return edges[:, 0], edges[:, 1] - edges[:, 0]


def _cuts(data: np.ndarray, a: int, b: int, step: int) -> list[int]:
    """Edges of pieces of about ``step`` bytes that do not cut a word."""
    edges = [a]
    while b - edges[-1] > step:
        at = edges[-1] + step
        while at < b:
            near = data[at : at + step]
            apart = np.flatnonzero((near < 0x30) | (near > 0x39) & (near < 0x61) | (near > 0x7A) & (near < 0x80))
            if len(apart):
                at += int(apart[0])
                break
            at += step
        edges.append(min(at, b))
    return [*edges, b]


class Features:
    """Buckets of the features of texts, for a column of them at a time."""

    def __init__(self, buckets: int):
        self.buckets, self.sums, self.split = buckets, Checksums(), _splitter()
        self.kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def _some(self, data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(words, buckets)`` of texts that are read together; ``edges`` tell them apart."""
        parts = [data[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        joined = b"\n".join(parts).lower()
        begin = np.concatenate([[0], np.cumsum(np.diff(edges) + 1)])
        start, size = _words(self.split, joined)
        register = self.sums.words(np.frombuffer(joined, np.uint8), start, size)
        bounds = np.searchsorted(start, begin)
        last = np.repeat(bounds[1:], np.diff(bounds))
        runs = [(c % np.uint32(self.buckets), at) for c, at in self.sums.runs(register, size, last)]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield b - a, np.concatenate([np.zeros(0, self.kind), *(c[a:b][at[a:b]].astype(self.kind) for c, at in runs)])

    def _long(self, data: np.ndarray, a: int, b: int) -> tuple[int, np.ndarray]:
        """The same for one long text, piece by piece; the last words of a piece begin runs of the next."""
        n, found = 0, []
        carry = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        edges = _cuts(data, a, b, PIECE)
        for i, j in zip(edges[:-1], edges[1:]):
            piece = data[i:j].tobytes().lower()
            start, size = _words(self.split, piece)
            old = len(carry[0])
            register = np.concatenate([carry[0], self.sums.words(np.frombuffer(piece, np.uint8), start, size)])
            size = np.concatenate([carry[1], size])
            for k, (c, _) in enumerate(self.sums.runs(register, size, np.full(len(size), len(size)))):
                found.append((c[max(0, old - k) :] % np.uint32(self.buckets)).astype(self.kind))
            n += len(size) - old
            carry = register[1 - RUNS :], size[1 - RUNS :]
        return n, np.concatenate([np.zeros(0, self.kind), *found])

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        data, offsets = text_buffer(column)
        for i, j in row_ranges(offsets, PIECE):
            if j == i + 1 and offsets[j] - offsets[i] > PIECE:
                yield self._long(data, int(offsets[i]), int(offsets[j]))
            else:
                yield from self._some(data, offsets[i : j + 1])


def feature_buckets(docs: DataFrame, buckets: int = 10000, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, buckets)`` of every whole text; ``buckets`` holds unsigned integers, one per feature."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = None
        for batch in batches:
            features = features or Features(buckets)
            _, offsets = text_buffer(batch.column(1))
            for i, j in row_ranges(offsets, 4 * PIECE):
                found = list(features(batch.column(1).slice(i, j - i)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([n for n, _ in found], pa.int64()),
                     pa.array([len(x) for _, x in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"],
                )

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def _integers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's integers, and where each row begins and ends in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data, width = column.buffers()[2], np.dtype(kind).itemsize
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), kind), (offsets - offsets[0]) // width


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket: ``buckets`` numbers, however many rows."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_integers(batch.column(0), kind)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int32()), "n": pa.array(total[held], pa.int64())})

    out = np.zeros(buckets, np.int64)
    parts = features.select("buckets").mapInArrow(run, "bucket int, n long")
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n = len(raw)
    ratio = ((target + 1).astype(float) * float(raw.sum() + n)) / ((raw + 1).astype(float) * float(target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _noise(seed: str) -> Column:
    """Thousandths of a Gumbel draw from the hash of the seed and the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = 10000, least_words: int = 20, percent: int = 5, seed: str = "42",
    id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``.

    ``weight`` sums the gains of all features of the whole text, ``score`` adds Gumbel noise drawn from the id, and
    ``rank`` counts the ``floor(percent / 100 * N)`` highest scores from 1, N being the rows with at least
    ``least_words`` words; other rows have no rank. Equal scores are ordered by id, rows without id last, then by their
    features. A null or empty text has no words, no features and weight 0. Rows that repeat an id are each ranked, with
    the same noise. Texts of any length are read whole, a piece at a time. An empty table gives an empty result, an
    empty target equal shares to all buckets. Other columns are ignored.
    """
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    features, _ = keep(feature_buckets(docs, buckets, id, text), "features")
    wanted, _ = keep(feature_buckets(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), buckets), "features")
    gain = docs.sparkSession.sparkContext.broadcast(gains(histogram(features, buckets), histogram(wanted, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = _integers(batch.column(3), kind)
            sums = np.concatenate([[0], np.cumsum(gain.value[flat])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64())], names=names)

    names = ["doc_id", "n_words", "n_features", "weight"]
    kinds = features.schema["doc_id"].dataType.simpleString()
    rows = features.mapInArrow(weigh, f"doc_id {kinds}, n_words long, n_features long, weight long")
    rows = rows.withColumn("score", F.col("weight") + _noise(seed))
    fit = F.col("n_words") >= least_words
    placed, total = numbered(rows, [F.desc(fit), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"], "place", fit)
    drawn = fit & (F.col("place") < percent * total // 100)
    return placed.withColumn("rank", F.when(drawn, F.col("place") + 1)).drop("place")
