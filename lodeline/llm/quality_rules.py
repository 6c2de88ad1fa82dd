"""Operator 5: text rules, and a log-likelihood ratio between a trusted corpus and the raw one.

Words and pairs of words are hashed into buckets and counted over all documents and over the trusted ones: two
multinomials of fixed size. A document's score is the mean over its n-grams of ``log(p_trusted / p_raw)``, where the
document's own n-grams are taken out of the raw counts, and the trusted counts lean on the raw ones while they are few.
Every document at or above a fixed threshold is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import SPACES, row_ranges, share, shared, text_buffer
from lodeline.llm.words import Hasher, Words, windows

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BUCKET_BITS = 14  # for words, and as many again for pairs
LEAN = 1 << 17  # how many n-grams the raw corpus counts for in the trusted one
THRESHOLD = -0.15
REPEAT = 5
_STRIP = "".join(map(chr, SPACES))


def buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of a text's words and pairs of words."""
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([(h >> shift).astype(np.int64), (windows(h, 2) >> shift).astype(np.int64) + (1 << BUCKET_BITS)])


def repeated_words(h: np.ndarray, size: int = REPEAT) -> int:
    """Words that lie in a run of ``size`` words which the text has twice or more."""
    runs = windows(h, size)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(h) + 1, np.int64)
    edges[: len(runs)] += twice
    edges[size : size + len(runs)] -= twice
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_STRIP)]
    return len(lines) - len(set(lines))


def sums_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each offset and the next; ``flags`` begins at the first offset."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets - offsets[0]])


class Counts:
    """N-gram counts of both corpora, and scores from them."""

    def __init__(self, raw: np.ndarray, trusted: np.ndarray):
        self.raw, self.trusted = raw, trusted
        self.n_raw, self.n_trusted = raw.sum(), trusted.sum()

    def score(self, h: np.ndarray) -> float:
        own, n = np.unique(buckets(h), return_counts=True)
        total = int(n.sum())
        if not total:
            return 0.0
        p = (self.raw[own] - n + 1.0) / (self.n_raw - total + len(self.raw))
        q = (self.trusted[own] + LEAN * p) / (self.n_trusted + LEAN)
        return float((np.log(q / p) * n).sum() / total)


def count_ngrams(docs: DataFrame, trusted: DataFrame) -> Counts:
    """Counts over all of ``docs(doc_id, text)``, and over those whose id is in ``trusted(doc_id)``."""
    size = 2 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, raw, own = Hasher(lower=False), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            marks = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i, j in row_ranges(offsets):
                w = hasher.words(data, offsets[i : j + 1])
                for k in range(j - i):
                    found = buckets(w.hash[w.first[k] : w.first[k + 1]])
                    n = np.bincount(found, minlength=size) if len(found) > size // 8 else None
                    for table in (raw, own) if marks[i + k] else (raw,):
                        if n is None:
                            np.add.at(table, found, 1)
                        else:
                            table += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(own[at])], names=["bucket", "raw", "own"])

    ids = trusted.select(F.col("doc_id").alias("its")).where("its is not null").distinct()
    # merged at any size: there may be as many trusted documents as others
    marked = docs.join(ids.hint("merge"), docs.doc_id == ids.its, "left").select("text", "its")
    parts = marked.mapInArrow(run, "bucket long, raw long, own long")
    raw, own = np.zeros(size), np.zeros(size)
    for r in parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).collect():  # one row per bucket
        raw[r.bucket], own[r.bucket] = r.raw, r.own
    return Counts(raw, own)


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def _judge(column: pa.Array, hasher: Hasher, counts: Counts, threshold: float) -> Iterator[tuple[int, int, list]]:
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    data, offsets = text_buffer(column)
    for i, j in row_ranges(offsets):
        at = offsets[i : j + 1]
        x = data[at[0] : at[-1]]
        w: Words = hasher.words(data, at)
        chars = sums_between(~hasher.space[x] & ((x & 0xC0) != 0x80), at)
        symbols = sums_between(symbol[x], at)
        texts = column.slice(i, j - i).to_pylist()
        n, dup, again, failed, score = np.diff(w.first), [], [], [], []
        for k, text in enumerate(texts):
            h = w.hash[w.first[k] : w.first[k + 1]]
            dup.append(repeated_lines(text or ""))
            again.append(repeated_words(h))
            failed.append(bool(len(h) < 10 or 100 * again[-1] > 20 * len(h)))
            score.append(counts.score(h))
        kept = [not f and s >= threshold for f, s in zip(failed, score)]
        whole = lambda v: pa.array(np.asarray(v, np.int64))
        yield i, j, [*map(whole, (n, chars, symbols, dup, again)), pa.array(failed), pa.array(kept), pa.array(score, pa.float64())]


def quality_rules(
    docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, only_kept: bool = False
) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score)`` of every row of
    ``docs``; with ``only_kept``, instead the rows that are kept, with all their columns.

    ``trusted`` names documents by ``doc_id``; ids that ``docs`` lacks, and repeated or null ones, change nothing. A null
    or empty text has no words and fails. Equal rows get equal verdicts. Without trusted documents every score is 0, so
    only the text rules decide. An empty table gives an empty result. Scores do not depend on how rows are dealt.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = share(spark, count_ngrams(rows, trusted))  # two arrays of fixed size

    if only_kept:
        place = docs.columns.index(text)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, own = Hasher(lower=False), shared(counts)
            for batch in batches:
                for i, j, found in _judge(batch.column(place), hasher, own, threshold):
                    yield batch.slice(i, j - i).filter(found[6])

        return docs.mapInArrow(choose, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(lower=False), shared(counts)
        for batch in batches:
            for i, j, found in _judge(batch.column(1), hasher, own, threshold):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *found], names=["doc_id", *_COLUMNS])

    longs = ", ".join(f"{c} long" for c in _COLUMNS[:5])
    return rows.mapInArrow(run, f"doc_id long, {longs}, base_failed boolean, kept boolean, score double")
