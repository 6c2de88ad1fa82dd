"""Extrapolation baselines: how the target would continue from its known part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.blocks import KEYS, block_totals, earlier_blocks, per_block, running, small_side, spread
from lodeline.operators.anchors import anchors, at_last_known

METHODS = ["flat", "slope_md", "slope_z", "slope_recent", "wls"]


def baseline(
    df: DataFrame,
    method: str = "flat",
    recent_window: int = 200,
    decay: float = 0.02,
    size: int | None = None,
) -> DataFrame:
    """``(well_id, row_idx, baseline)``; NULL on known rows and in series without any known value."""
    if method not in METHODS:
        raise ValueError(f"unknown baseline method: {method}")
    return baselines(df, [method], recent_window, decay, size).withColumnRenamed(f"baseline_{method}", "baseline")


def baselines(
    df: DataFrame,
    methods: list[str],
    recent_window: int = 200,
    decay: float = 0.02,
    size: int | None = None,
) -> DataFrame:
    """Several methods at once: one set of per-series slopes joined to the unknown rows."""
    known = F.col("tvt_input").isNotNull()
    per_series = anchors(
        df,
        known_rows=F.count("tvt_input"),
        md_last=at_last_known("md"),
        z_last=at_last_known("z"),
        slope_md=F.regr_slope("tvt_input", F.when(known, F.col("md"))),
        slope_z=F.regr_slope("tvt_input", F.when(known, F.col("z"))),
    )
    if {"slope_recent", "wls"} & set(methods):
        per_series = per_series.join(_recent_slopes(df, recent_window, decay, size), "well_id", "left")
    rows = spread(df.filter("tvt_input IS NULL"), size=size).join(per_block(per_series, size), KEYS)

    def value(method: str) -> Column:
        if method == "flat":
            return F.col("last_known")
        x = "z" if method == "slope_z" else "md"
        trend = F.col("last_known") + F.col(method) * (F.col(x) - F.col(f"{x}_last"))
        return F.when(F.col("known_rows") < 2, F.col("last_known")).otherwise(trend)

    unknown = rows.select("well_id", "row_idx", *[value(m).alias(f"baseline_{m}") for m in methods])
    nothing = [F.lit(None).cast("double").alias(f"baseline_{m}") for m in methods]
    return unknown.unionByName(df.filter(known).select("well_id", "row_idx", *nothing))


def _recent_slopes(df: DataFrame, recent_window: int, decay: float, size: int | None) -> DataFrame:
    """Per series, plain and weighted slope over its last ``recent_window`` known rows.

    Known rows are ranked inside blocks; blocks that end too early to hold one of the last rows are dropped
    before any row is shuffled.
    """
    totals = block_totals(df, size, _k=F.count("tvt_input"))
    whole = Window.partitionBy("well_id")
    counted = totals.select(
        *KEYS,
        F.coalesce(F.sum("_k").over(earlier_blocks()), F.lit(0)).alias("_earlier"),
        F.sum("_k").over(whole).alias("_known"),
        "_k",
    ).filter(F.col("_earlier") + F.col("_k") > F.col("_known") - recent_window)
    known = spread(df.filter("tvt_input IS NOT NULL").select("well_id", "row_idx", "md", "tvt_input"), size=size)
    ranked = (
        known.join(small_side(counted), KEYS)
        .withColumn("_rank", F.col("_earlier") + F.count("*").over(running()))
        .withColumn("_count", F.least(F.lit(recent_window), F.col("_known")))
        .withColumn("_age", F.col("_rank") - 1 - (F.col("_known") - F.col("_count")))
        .filter("_age >= 0")
    )
    # Weighted least squares minimises sum (w e)^2, so each row counts with its squared weight.
    weight = F.exp(2.0 * decay * F.col("_age"))
    means = (
        ranked.withColumn("_w", weight)
        .groupBy("well_id")
        .agg(
            (F.sum(F.col("_w") * F.col("md")) / F.sum("_w")).alias("_mx"),
            (F.sum(F.col("_w") * F.col("tvt_input")) / F.sum("_w")).alias("_my"),
            F.regr_slope("tvt_input", "md").alias("slope_recent"),
        )
    )
    centred = ranked.withColumn("_w", weight).join(means, "well_id")
    dx, dy = F.col("md") - F.col("_mx"), F.col("tvt_input") - F.col("_my")
    return centred.groupBy("well_id").agg(
        F.max("slope_recent").alias("slope_recent"),
        F.try_divide(F.sum(F.col("_w") * dx * dy), F.sum(F.col("_w") * dx * dx)).alias("wls"),
    )

