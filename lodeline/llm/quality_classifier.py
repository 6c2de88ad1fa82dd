"""Operator 9: a quality score from random Fourier features of document statistics.

Statistics of the text alone are standardised and mapped by ``sqrt(2 / D) * cos(x W + b)`` with Gaussian ``W``, whose inner
products approximate a Gaussian kernel. Each task sums the normal equations of its labelled rows, the sums are added row
by row of the matrix, and ridge weights come from one small system. Scores of labelled rows that had no part in the fit
are brought to probabilities by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import SPACES, keep, row_ranges, text_buffer
from lodeline.llm.quality_rules import SYMBOLS, repeated_lines, repeated_words, sums_between
from lodeline.llm.words import Hasher

FEATURES = 256
WIDTH = 3.0  # of the kernel, in standard deviations
RIDGE = 1e-3  # of the mean of the diagonal
BINS = 1024
TRAIN_ROWS = 200_000  # labelled rows at most, chosen by hash
STATISTICS = (
    "words", "bytes", "word_chars", "symbols", "upper", "digits", "marks", "other_letters", "feeds", "dup_lines",
    "repeat_words", "distinct_words", "shouts", "bars", "line_words", "sentence_ends", "longest_word", "word_spread",
)


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def statistics(column: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray]]:
    """Statistics of each text of a column, in ranges of rows. All are shares or logarithms; an empty text has zeros."""
    sets = {
        "symbols": _flags(SYMBOLS), "upper": _flags(bytes(range(65, 91))), "digits": _flags(b"0123456789"), "feeds": _flags(b"\n"),
        "marks": _flags(bytes(b for b in range(33, 127) if not chr(b).isalnum())), "other_letters": _flags(bytes(range(192, 256))),
        "shouts": _flags(b"!"), "bars": _flags(b"|"), "ends": _flags(b".?!"),
    }
    data, offsets = text_buffer(column)
    for i, j in row_ranges(offsets):
        at = offsets[i : j + 1]
        x = data[at[0] : at[-1]]
        w = hasher.words(data, at)
        n = np.diff(w.first).astype(float)
        size = np.diff(at).astype(float)
        of = {k: sums_between(v[x], at).astype(float) for k, v in sets.items()}
        chars = sums_between(~hasher.space[x] & ((x & 0xC0) != 0x80), at).astype(float)
        texts = column.slice(i, j - i).to_pylist()
        dup, again, distinct, longest, spread, lines = (np.zeros(j - i) for _ in range(6))
        for k, text in enumerate(texts):
            a, b = w.first[k], w.first[k + 1]
            if a < b:
                long = (w.end[a:b] - w.start[a:b]).astype(float)
                dup[k], again[k], distinct[k] = repeated_lines(text), repeated_words(w.hash[a:b]), len(np.unique(w.hash[a:b]))
                longest[k], spread[k] = long.max(), long.std()
            lines[k] = 1 + of["feeds"][k]
        per_char, per_word = 1 / np.maximum(chars, 1), 1 / np.maximum(n, 1)
        yield i, j, np.stack(
            [
                np.log1p(n), np.log1p(size), chars * per_word, of["symbols"] * per_char, of["upper"] * per_char, of["digits"] * per_char,
                of["marks"] * per_char, of["other_letters"] * per_char, of["feeds"] * per_word, dup / lines, again * per_word,
                distinct * per_word, of["shouts"] * per_word, of["bars"] * per_word, np.log1p(n / lines), of["ends"] * per_word,
                np.log1p(longest), np.log1p(spread),
            ], 1,
        )


class Kernel:
    """Standardises statistics and maps them to random Fourier features, with a constant as the last one."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        rng = np.random.default_rng(9)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def normal_equations(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """Sums of ``z z'`` and, as a last column, of ``z y`` over ``rows(x, y)``: one small matrix, in a fixed order."""
    size = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                z = kernel(_matrix(some.column(0)))
                total += z.T @ np.hstack([z, some.column(1).to_numpy()[:, None]])
        if total.any():
            own = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(size)), pa.array([own] * size), pa.array(list(total))], names=["i", "part", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(2))):
                sums[i] = sums.get(i, 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()))], names=["i", "v"])

    parts = rows.mapInArrow(part, "i long, part long, v array<double>").repartition("i").sortWithinPartitions("i", "part")
    out = np.zeros((size, size + 1))
    for r in parts.mapInArrow(add, "i long, v array<double>").collect():  # one row for each feature
        out[r.i] = r.v
    return out


def isotonic(score: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order of ``score``. Points ``(score, share of ones)`` to interpolate."""
    blocks: list[list[float]] = []
    for s, a, b in zip(score, ones, n):
        blocks.append([s * b, a, b])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    sums = np.array(blocks).reshape(-1, 3)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    ``labels`` marks some ids with 1 or 0. Ids fall into three parts by ``crc32(id) mod 3``: 0 fits, 2 calibrates, 1 is held
    out and never learned from. An id that is labelled twice counts once, as 1 if any label says so; null ids and labels
    are left out. At most ``TRAIN_ROWS`` labelled rows, chosen by hash of their ids, are learned from. Scores come
    from statistics of the whole text alone, so equal texts score alike, and null and empty texts score as texts without
    words. A row without an id is not held out. Without labels to fit, every score is 0.5; without any to calibrate
    by, scores are the fit's own, cut to 0..1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=False, separators=SPACES)
        for batch in batches:
            for i, j, x in statistics(batch.column(1), hasher):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    measured, _ = keep(rows.mapInArrow(measure, "doc_id long, x array<double>"), "statistics")
    fold = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(3))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    marks = marks.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = marks.withColumn("fold", fold("doc_id")).where("fold <> 1")
    share = min(1.0, TRAIN_ROWS / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    known, _ = keep(measured.join(marks, "doc_id").select("x", "y", "fold"), "labelled")

    width = len(STATISTICS)
    fit = known.where("fold = 0").select("x", "y")
    moments = [f(F.col("x")[k]) for k in range(width) for f in (F.avg, F.stddev_pop)]
    first = fit.agg(F.count("*"), *moments).first()
    weights = bend = None
    if first[0]:
        values = np.array(first[1:], float)
        kernel = Kernel(values[::2], values[1::2])
        sums = normal_equations(fit, kernel)
        a, b = sums[:, :-1], sums[:, -1]
        ridge = np.full(len(a), RIDGE * np.trace(a) / len(a))
        ridge[-1] = 0.0  # the constant is free
        weights = np.linalg.solve(a + np.diag(ridge + 1e-12), b)

        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    s = np.clip(kernel(_matrix(batch.column(0))) @ weights, -0.5, 1.5)
                    yield pa.RecordBatch.from_arrays([pa.array(np.floor((s + 0.5) / 2 * BINS).astype(int)), batch.column(1)], names=["bin", "y"])

        binned = known.where("fold = 2").select("x", "y").mapInArrow(raw, "bin long, y double")
        bins = binned.groupBy("bin").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("bin").collect()  # a row per bin
        if bins:
            at = np.array([r.bin for r in bins])
            bend = isotonic((at + 0.5) / BINS * 2 - 0.5, np.array([r.ones for r in bins]), np.array([r.n for r in bins], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = np.full(batch.num_rows, 0.5)
            if weights is not None:
                out = np.clip(kernel(_matrix(batch.column(1))) @ weights, 0, 1) if bend is None else np.interp(
                    np.clip(kernel(_matrix(batch.column(1))) @ weights, -0.5, 1.5), *bend
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    scored = measured.mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(fold("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
