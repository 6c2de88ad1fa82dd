"""Cut row, last known value and other per-series constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.blocks import KEYS, per_block, settle, spread

# Row of each value: where the target is unknown, and where it is known. NULL ordering keys are ignored
# by max_by/min_by, so these pick the first unknown and the last known row.
def unknown_at() -> Column:
    return F.when(F.col("tvt_input").isNull(), F.col("row_idx"))


def known_at() -> Column:
    return F.when(F.col("tvt_input").isNotNull(), F.col("row_idx"))


def at_cut(c: str) -> Column:
    """Aggregate: value at the cut row, or at the last row when nothing is unknown."""
    some_unknown = F.min(unknown_at()).isNotNull()
    return F.when(some_unknown, F.min_by(c, unknown_at())).otherwise(F.max_by(c, F.col("row_idx")))


def at_last_known(c: str) -> Column:
    return F.max_by(c, known_at())


def anchors(df: DataFrame, **extra: Column) -> DataFrame:
    """One row per series: ``n``, ``ps`` (cut row), ``has_cut``, ``last_known`` and any extra aggregates.

    Every aggregate here has a constant-size buffer and combines map-side, so a long series costs one row per
    input partition in the shuffle.
    """
    return df.groupBy("well_id").agg(
        F.count("*").alias("n"),
        F.coalesce(F.min(unknown_at()), F.max("row_idx")).alias("ps"),
        F.min(unknown_at()).isNotNull().alias("has_cut"),
        F.max_by("tvt_input", known_at()).alias("last_known"),
        *[e.alias(name) for name, e in extra.items()],
    )


def named_extra(name: str) -> Column:
    """``<column>_cut``, ``<column>_last``, ``<column>_min`` or ``<column>_max`` as an aggregate."""
    column, kind = name.rsplit("_", 1)
    makers = {"cut": at_cut, "last": at_last_known, "min": F.min, "max": F.max}
    return makers[kind](column)


def with_anchors(df: DataFrame, *extra: str, size: int | None = None) -> DataFrame:
    """Every row with the constants of its series."""
    return settle(join_anchors(spread(df, size=size), anchors(df, **{e: named_extra(e) for e in extra}), size), size)


def join_anchors(blocked: DataFrame, per_series: DataFrame, size: int | None = None) -> DataFrame:
    """Join per-series constants to rows already keyed by ``(well_id, block)``."""
    return blocked.join(per_block(per_series, size), KEYS)


def last_known(df: DataFrame) -> DataFrame:
    return anchors(df).select("well_id", "last_known")


def cut_index(df: DataFrame) -> DataFrame:
    return anchors(df).select("well_id", F.col("n").cast("int").alias("n"), "ps", "has_cut")


def post_cut_rows(df: DataFrame) -> DataFrame:
    """Rows whose target is unknown: a row-wise test, not everything after the cut."""
    return df.filter("tvt_input IS NULL")


def strict_anchors(df: DataFrame) -> DataFrame:
    """As ``anchors`` but a series without a cut or without any known value is an error."""
    bad = F.col("last_known").isNull() | ~F.col("has_cut")
    msg = F.concat(F.lit("series without cut row or known value: "), F.col("well_id"))
    return anchors(df).withColumn("ps", F.when(bad, F.raise_error(msg).cast("int")).otherwise(F.col("ps")))


def train_rows(df: DataFrame, baseline: Column | None = None) -> DataFrame:
    """Unknown rows with a finite target; a series with any missing baseline is dropped whole."""
    baseline = baseline if baseline is not None else F.col("last_known")
    rows = join_anchors(spread(df), anchors(df)).withColumn("baseline", baseline)
    unknown = rows.filter(F.col("tvt_input").isNull())
    incomplete = unknown.filter(F.col("baseline").isNull()).groupBy("well_id").agg(F.max("n").alias("n"))
    finite = F.col("tvt").isNotNull() & ~F.isnan("tvt") & (F.abs("tvt") < float("inf"))
    return unknown.join(per_block(incomplete), KEYS, "left_anti").filter(finite).select("well_id", "row_idx", "tvt", "baseline")
