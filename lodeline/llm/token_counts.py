"""Operator 8: token counts through two tiers of lookups on the map side; no pre-token is shuffled.

The first tier is a table of the lengths of frequent pre-tokens, broadcast at a fixed size. It is drawn up from the
leading pre-tokens of a bounded sample of rows, which only decides what is fast: any other pre-token is encoded by the
library in the task and remembered in the worker's own bounded cache.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import row_ranges, slices, text_buffer, worker_store
from lodeline.llm.tokens import PIECE, Encoder, splits_at_spaces

SAMPLE_ROWS = 20_000
TABLE = 1 << 16
LEADING = 1 << 13  # of each sampled task


def frequent_lengths(docs: DataFrame, content: bytes, rows: int = SAMPLE_ROWS, size: int = TABLE) -> dict:
    """Lengths in tokens of the pre-tokens that lead in about ``rows`` rows, as chunks of :class:`Encoder`."""

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in (part for whole in batches for part in slices(whole)):
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    first, *rest = line.split(" ")
                    counts[0].update(rest)
                    counts[1][first] += 1
            for c in counts:
                if len(c) > 1 << 19:  # keep what leads so far
                    for k, _ in c.most_common()[1 << 18 :]:
                        del c[k]
        for k, c in enumerate(counts):
            top = [x for x in c.most_common(LEADING) if x[0] and len(x[0]) < 64 and not x[0][0].isspace() and not x[0][-1].isspace()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(top), pa.int32()), pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.int64())],
                names=["begin", "chunk", "n"],
            )

    total = max(1, docs.count())
    share = min(1.0, rows / total)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    found = sample.mapInArrow(leading, "begin int, chunk string, n long").groupBy("begin", "chunk").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "begin", "chunk").limit(size).collect()
    encoder = Encoder(content, None)
    lengths = map(len, encoder.ids([r.chunk if r.begin else " " + r.chunk for r in top]))
    return {"\n" * r.begin + r.chunk: n + r.begin * encoder.feed for r, n in zip(top, lengths)}


def _pack(lengths: dict) -> tuple[str, bytes]:
    return " ".join(lengths), np.array(list(lengths.values()), np.uint16).tobytes()


def _unpack(packed: tuple[str, bytes]) -> dict:
    return dict(zip(packed[0].split(" "), np.frombuffer(packed[1], np.uint16).tolist())) if packed[1] else {}


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row.

    ``path`` names a tokenizer file, read on the driver: ``.json`` for the tokenizers library, ``.model`` for
    sentencepiece. Texts are whole; nothing is added, cut or padded, and special strings in a text count as the library
    has them by default. A null text counts as empty: no bytes, no tokens, not over the limit. Every row, also one that
    repeats another, gives one row. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    with open(path, "rb") as f:
        content = f.read()
    file = spark.sparkContext.broadcast(content)
    pieces = path.endswith(".model")
    table = frequent_lengths(docs, content, sample_rows) if not pieces and splits_at_spaces(content) else {}
    first = spark.sparkContext.broadcast(_pack(table))

    def counter():
        if pieces:
            import sentencepiece

            store = worker_store()
            if ("pieces", file.value) not in store:
                store["pieces", file.value] = sentencepiece.SentencePieceProcessor(model_proto=file.value)
            model = store["pieces", file.value]
            return lambda column: [len(model.encode(t or "")) for t in column.to_pylist()]
        return Encoder(file.value, None, _unpack(first.value)).count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            _, offsets = text_buffer(batch.column(2))
            for i, j in row_ranges(offsets, PIECE):
                n = count(batch.column(2).slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
