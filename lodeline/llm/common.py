"""Helpers shared by the corpus operators: tables, the shared folder, Arrow batches and hashes."""

from __future__ import annotations

import pickle
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.session import shared_dir

#: The white space that separates words (space, tab, line feed, vertical tab, form feed, return).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as patterns of Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

PIECE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{shared_dir(spark)}/lodeline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back, so that a lost executor costs nothing before this point."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that the table does not have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that :func:`keep` wrote, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: list[Column | str], name: str, counted: Column) -> tuple[DataFrame, int]:
    """All rows with their place in ``order``, from 0, and how many rows are ``counted``.

    Rows are dealt by ranges of the order and sorted in their tasks; a part's base is a sum over one row per part.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # part in the upper bits, place in the part in the lower 33
    rows, _ = keep(rows.withColumn(name, at), "numbered")
    part = F.shiftright(name, 33)
    parts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(counted).alias("counted"))
    listed = parts.orderBy("part").collect()  # one row per part
    bases, base = [], 0
    for r in listed:
        bases.append((r.part, base - (r.part << 33)))
        base += r.n
    shift = df.sparkSession.createDataFrame(bases, "part_ long, base_ long")
    out = rows.join(F.broadcast(shift), part == F.col("part_")).withColumn(name, F.col(name) + F.col("base_"))
    return out.drop("part_", "base_"), sum(r.counted for r in listed)


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of one of our classes, with its class, since workers need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast: Broadcast):
    return pickle.loads(broadcast.value)


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker. Task functions travel by value, so their own module-level
    variables start anew with each task."""
    home = sys.modules.setdefault("_lodeline_worker", types.ModuleType("_lodeline_worker"))
    return home.__dict__.setdefault("store", {})


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row begins and ends in them. Null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def row_ranges(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch a few rows at a time, where they become Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))
