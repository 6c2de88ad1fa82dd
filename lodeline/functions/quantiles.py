"""Exact quantiles with linear interpolation, per group or over a whole table.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. That is used only for groups whose
row count was checked against ``limit``. Larger groups are first reduced to value counts, then to a histogram;
only the buckets that hold a wanted rank are ranked value by value.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_GROUP = 1 << 20
BUCKETS = 4096


def quantiles(
    df: DataFrame,
    keys: list[str],
    cols: list[str],
    probs: list[float],
    limit: int = SMALL_GROUP,
) -> DataFrame:
    """One row per group: ``keys`` and, for each column, an array of its quantiles in the order of ``probs``."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    large = sizes.filter(F.col("_rows") > limit)
    if large.isEmpty():
        return _in_one_buffer(df, keys, cols, probs)
    if not keys:
        return _by_histogram(df, keys, cols, probs)
    # Hot groups are few, so their key list is what gets joined to the rows, not the rows to it.
    hot = large.select(*keys)
    small_part = _in_one_buffer(df.join(hot, keys, "left_anti"), keys, cols, probs)
    return small_part.unionByName(_by_histogram(df.join(hot, keys, "left_semi"), keys, cols, probs))


def medians(df: DataFrame, keys: list[str], cols: list[str], limit: int = SMALL_GROUP) -> DataFrame:
    """One row per group with the median of each column under the column's own name."""
    q = quantiles(df, keys, cols, [0.5], limit)
    return q.select(*keys, *[F.col(c)[0].alias(c) for c in cols])


def _in_one_buffer(df: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    return df.groupBy(*keys).agg(*[F.percentile(c, wanted).alias(c) for c in cols])


def _by_histogram(df: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    long = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in cols])).alias("_s")
    ).select(*keys, "_s._c", "_s._v")
    group = [*keys, "_c"]
    counts = long.filter("_v IS NOT NULL").groupBy(*group, "_v").agg(F.count("*").alias("_k"))
    # Equal-width narrowing, twice: a bucket of a bucket holds about one value in 16 million.
    start = counts.groupBy(*group).agg(F.sum("_k").alias("_n")).withColumn("_below", F.lit(0).cast("bigint"))
    found = counts.join(start, group)
    ranks = [r for p in probs for r in _rank_exprs(p)]
    part: list[str] = []
    for level in ("_b1", "_b2"):
        found = _narrow(found, group, part, level, ranks)
        part.append(level)
    w = Window.partitionBy(*group, *part).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("_end", F.col("_below") + F.sum("_k").over(w))
    start_rank = F.col("_end") - F.col("_k")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((start_rank <= rank) & (rank < F.col("_end")), F.col("_v")))

    picks = []
    for i, p in enumerate(probs):
        lo, hi = _rank_exprs(p)
        picks += [value_at(lo).alias(f"_lo{i}"), value_at(hi).alias(f"_hi{i}")]
    flat = placed.groupBy(*group).agg(F.max("_n").alias("_n"), *picks)
    parts = []
    for i, p in enumerate(probs):
        t = F.lit(p) * (F.col("_n") - 1)
        t = t - F.floor(t)
        parts.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * t)
    arrays = flat.select(*group, F.array(*parts).alias("_q"))
    return arrays.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == c, F.col("_q"))).alias(c) for c in cols])


def _rank_exprs(p: float) -> tuple[Column, Column]:
    h = F.lit(p) * (F.col("_n") - 1)
    return F.floor(h), F.ceil(h)


def _narrow(found: DataFrame, group: list[str], part: list[str], name: str, ranks: list[Column]) -> DataFrame:
    """Keep the values of the buckets that contain a wanted rank, with the number of values below each bucket."""
    here = [*group, *part]
    span = found.groupBy(*here).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    cell = F.when(
        F.col("_max") > F.col("_min"),
        F.least(
            F.lit(BUCKETS - 1).cast("bigint"),
            F.floor((F.col("_v") - F.col("_min")) / (F.col("_max") - F.col("_min")) * BUCKETS),
        ),
    ).otherwise(F.lit(0).cast("bigint"))
    bucketed = found.join(span, here).withColumn(name, cell).drop("_min", "_max")
    before = Window.partitionBy(*here).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        bucketed.groupBy(*here, name)
        .agg(F.sum("_k").alias("_in"), F.max("_n").alias("_n"), F.max("_below").alias("_below"))
        .withColumn("_below", F.col("_below") + F.coalesce(F.sum("_in").over(before), F.lit(0)))
    )
    holds = reduce(
        lambda a, b: a | b, [(F.col("_below") <= r) & (r < F.col("_below") + F.col("_in")) for r in ranks]
    )
    kept = hist.filter(holds).select(*here, name, "_below")
    return bucketed.drop("_below").join(kept, [*here, name])


def quantile_edges(bins: int) -> list[float]:
    """Probabilities of the edges of ``bins`` equal-count bins."""
    return [i / bins for i in range(bins + 1)]


def bin_right_closed(value: Column, edges: Column) -> Column:
    """Index of the bin (edge[k], edge[k+1]] that holds ``value``; the lowest edge belongs to bin 0.

    ``edges`` is a short ascending array column; repeated edges must have been removed.
    """
    above = F.size(F.filter(edges, lambda e: e < value))
    return F.greatest(above - 1, F.lit(0))


def percentile_label(p: float) -> str:
    return f"p{math.floor(p) if p == math.floor(p) else p}"
