"""Row blocks: how ordered work on a series is spread over tasks.

A series may hold any share of all rows, so no task is given a whole series. Rows are keyed by
``(well_id, block)`` with ``block = row_idx div size``. A frame of bounded width gets the few rows it needs
from the neighbouring blocks as copies (the halo). A running value is computed inside each block and joined
to a carry, which comes from one small row per block. Results do not depend on the block size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16
KEYS = ["well_id", "block"]


def block_of(size: int | None = None, shift: int = 0) -> Column:
    return F.floor((F.col("row_idx") + shift) / (size or BLOCK_ROWS))


def spread(df: DataFrame, before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Add ``block``; rows within ``before``/``after`` of a neighbouring block are copied into it.

    ``before`` is how far a frame looks back, ``after`` how far it looks ahead.
    """
    if not before and not after:
        return df.withColumn("block", block_of(size))
    first = F.greatest(block_of(size, -after), F.lit(0).cast("bigint"))
    return df.withColumn("block", F.explode(F.sequence(first, block_of(size, before))))


def is_home(size: int | None = None) -> Column:
    """True on a row's own copy, false on halo copies."""
    return F.col("block") == block_of(size)


def settle(df: DataFrame, size: int | None = None) -> DataFrame:
    """Drop the halo copies and the block column."""
    return df.filter(is_home(size)).drop("block")


def rows() -> WindowSpec:
    """Rows of one block in series order."""
    return Window.partitionBy(*KEYS).orderBy("row_idx")


def frame(before: int, after: int) -> WindowSpec:
    return rows().rowsBetween(-before, after)


def running() -> WindowSpec:
    return rows().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def onward() -> WindowSpec:
    """From the end of the block back to the current row.

    Read in descending order, as Spark would start a frame with a moving start over for every row. The nearest
    later row is the last of the frame.
    """
    return Window.partitionBy(*KEYS).orderBy(F.desc("row_idx")).rowsBetween(Window.unboundedPreceding, 0)


def earlier_blocks() -> WindowSpec:
    """Over the table of block totals: all blocks before this one."""
    return Window.partitionBy("well_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def later_blocks() -> WindowSpec:
    """All blocks after this one, the nearest last."""
    return Window.partitionBy("well_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)


def block_totals(df: DataFrame, size: int | None = None, **aggs: Column) -> DataFrame:
    """One row per ``(well_id, block)``; aggregated map-side before the shuffle."""
    return df.groupBy("well_id", block_of(size).alias("block")).agg(*[e.alias(n) for n, e in aggs.items()])


def per_block(per_series: DataFrame, size: int | None = None, rows_col: str = "n") -> DataFrame:
    """Repeat a per-series row for each block of the series.

    Joining on ``(well_id, block)`` instead of ``well_id`` splits a long series over tasks and leaves the rows
    partitioned the way the following windows need them.
    """
    last = F.floor((F.col(rows_col) - 1) / (size or BLOCK_ROWS))
    return small_side(per_series.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))))


def small_side(df: DataFrame) -> DataFrame:
    """Mark the table of one row per block as the one to hash in a join on ``(well_id, block)``.

    Both sides are then partitioned by block once, which the windows that follow reuse. Nothing is broadcast, as
    the number of series has no bound, and the rows are sorted only for the windows.
    """
    return df.hint("shuffle_hash")
