"""Operator 2: token ids of a corpus as flat binary files with 64-bit document offsets.

``part-N.bin`` holds ids as little-endian unsigned integers: 16 bits where the vocabulary fits, else 32. Its documents
stand in ascending id order, and the parts follow each other in that order. ``part-N.idx`` has, as unsigned 64-bit
integers, where each document begins in the whole corpus, and the end of the last one; ``part-N.ids`` has the documents'
ids. A part's base is the number of ids in all parts before it, a prefix sum over one row per part.

Files are written under a name of their own attempt and renamed when complete, so a task that runs again, or twice,
leaves one whole file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import folder, keep, row_ranges, text_buffer
from lodeline.llm.tokens import PIECE, Encoder, load

NO_ID = -(1 << 63)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _File:
    """A file that gets its name when it is complete."""

    def __init__(self, uri: str, name: str):
        self.fs, path = _store(uri)
        self.fs.create_dir(path, recursive=True)
        self.own, self.name = f"{path}/.{name}.{uuid.uuid4().hex}", f"{path}/{name}"
        self.out = self.fs.open_output_stream(self.own)

    def write(self, data) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.name)


def _mapped(uri: str, name: str, kind: str) -> np.ndarray:
    """A file's integers: memory-mapped where the store is a mounted file system, else read."""
    fs, path = _store(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(f"{path}/{name}") as f:
            return np.frombuffer(f.read_buffer(), kind)
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def write_tokens(docs: DataFrame, content: bytes, end_id: int, to: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, end each with ``end_id``, and write the files. Returns the parts:
    ``(folder, part, docs, tokens, base, width)``.

    ``content`` is a tokenizer file's content. A null or empty text is the end id alone. Rows with equal ids, or with
    none (which come first), follow each other by a hash of their texts, so none of them has to fit one part. An empty
    table gives no parts. Other columns are ignored.
    """
    spark = docs.sparkSession
    to = to or folder(spark, "tokens")
    tokenizer, _ = load(content)
    width = 2 if max(tokenizer.get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
    file = spark.sparkContext.broadcast(content)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, sizes = TaskContext.get().partitionId(), [], []
        out = encoder = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = _File(to, f"part-{part:06d}.bin")
                encoder = Encoder(file.value, width)
            ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
            _, offsets = text_buffer(batch.column(1))
            for i, j in row_ranges(offsets, PIECE):
                found, bounds = encoder.encode(batch.column(1).slice(i, j - i))
                out.write(np.insert(found, bounds[1:], end_id).tobytes())
                sizes.append(np.diff(bounds) + 1)
        if out is None:
            return
        out.close()
        sizes = np.concatenate(sizes).astype("<u8")
        for name, values in (("ids", np.concatenate(ids).astype("<i8")), ("sizes", sizes)):
            side = _File(to, f"part-{part:06d}.{name}")
            side.write(values.tobytes())
            side.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(sizes)], "tokens": [int(sizes.sum())]})

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    parts, _ = keep(rows.mapInArrow(write, "part long, docs long, tokens long"), "parts")
    listed = parts.orderBy("part").collect()  # one row per part
    bases = accumulate((r.tokens for r in listed), initial=0)
    table = [(to, r.part, r.docs, r.tokens, base, width) for r, base in zip(listed, bases)]
    out = spark.createDataFrame(table, "folder string, part long, docs long, tokens long, base long, width int")
    return keep(_dealt(out).mapInArrow(_offsets, out.schema), "parts")[0]


def _dealt(parts: DataFrame) -> DataFrame:
    """A task for each few parts; their rows are tiny, so Spark must not put them together."""
    spark = parts.sparkSession
    return parts.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes each part's offsets from its base."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes = _mapped(row["folder"], f"part-{row['part']:06d}.sizes", "<u8")
            out = _File(row["folder"], f"part-{row['part']:06d}.idx")
            out.write((np.concatenate([[0], np.cumsum(sizes)]) + row["base"]).astype("<u8").tobytes())
            out.close()
        yield batch


def read_tokens(parts: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, part)`` of every document, from the files alone. ``start`` counts the ids of
    all documents before it; the checksum is over the ids as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"part-{row['part']:06d}"
                ids = _mapped(row["folder"], f"{name}.ids", "<i8")
                at = _mapped(row["folder"], f"{name}.idx", "<u8").astype(np.int64)
                flat = _mapped(row["folder"], f"{name}.bin", f"<u{row['width']}")
                local = at - at[0]
                for i in range(0, len(ids), 10000):
                    some = range(i, min(i + 10000, len(ids)))
                    crc = [zlib.crc32(flat[local[k] : local[k + 1]].astype("<u4").tobytes()) for k in some]
                    own = ids[some.start : some.stop]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(own, pa.int64(), mask=own == NO_ID), "start": at[some.start : some.stop],
                         "n_tokens": np.diff(at[some.start : some.stop + 1]), "ids_crc32": pa.array(crc, pa.int64()),
                         "part": pa.array([row["part"]] * len(some), pa.int64())}
                    )

    return _dealt(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part long")
