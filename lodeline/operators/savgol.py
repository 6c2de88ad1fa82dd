"""Savitzky-Golay smoothing, clipping and the scored grid of post-processing settings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.blocks import BLOCK_ROWS, KEYS, block_of, earlier_blocks, per_block, rows, settle, small_side, spread
from lodeline.functions.quantiles import quantiles
from lodeline.functions.scalars import clip

# Fixed values of the search grid.
WINDOWS = (5, 11, 17, 25, 31, 41, 51)
POLYORDERS = (2, 3)
CLIP_PERCENTILES = ((0.1, 99.9), (0.5, 99.5), (1.0, 99.0))
MIN_DELTA = 0.01


def fit_matrix(window: int, polyorder: int) -> np.ndarray:
    """Row r gives the fitted polynomial's value at place r from the ``window`` values."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1) / max(half, 1), polyorder + 1, increasing=True)
    return design @ np.linalg.pinv(design)


def check_settings(window: int | None, polyorder: int) -> None:
    if window is None:
        return
    if window % 2 == 0 or window < 3 or polyorder < 0 or polyorder >= window:
        raise ValueError(f"invalid smoothing settings: window={window} polyorder={polyorder}")


def with_position(df: DataFrame, size: int | None = None) -> DataFrame:
    """Add ``pos``, the rank of a row in its series, and ``n``; rows may have gaps in ``row_idx``."""
    ends = df.groupBy("well_id").agg(
        F.min("row_idx").alias("_first"), F.max("row_idx").alias("_last"), F.count("*").alias("n")
    )
    gaps = ends.filter(F.col("_last") - F.col("_first") + 1 != F.col("n"))
    spans = ends.withColumn("_rows", F.col("_last") + 1)
    blocked = spread(df, size=size)
    if gaps.isEmpty():
        known = small_side(per_block(spans, size, "_rows").select(*KEYS, "_first", "n"))
        return blocked.join(known, KEYS).withColumn("pos", F.col("row_idx") - F.col("_first")).drop("block", "_first")
    totals = df.groupBy("well_id", block_of(size).alias("block")).agg(F.count("*").alias("_k"))
    carry = totals.select(
        *KEYS,
        F.coalesce(F.sum("_k").over(earlier_blocks()), F.lit(0)).alias("_before"),
        F.sum("_k").over(Window.partitionBy("well_id")).alias("n"),
    )
    ranked = blocked.withColumn("_i", F.row_number().over(rows()) - 1).join(small_side(carry), KEYS)
    return ranked.withColumn("pos", (F.col("_i") + F.col("_before")).cast("int")).drop("block", "_i", "_before")


def smooth(
    df: DataFrame, value: str = "tvt", window: int = 31, polyorder: int = 2, size: int | None = None
) -> DataFrame:
    """Replace ``value`` by its smoothed form; a series of at most ``window`` rows is left unchanged.

    Inside, each row is a fixed weighted sum of its neighbours. The first and last half-windows take the value of
    the polynomial fitted to the first or last ``window`` rows.
    """
    check_settings(window, polyorder)
    half, fit = window // 2, fit_matrix(window, polyorder)
    placed = with_position(df, size).withColumnRenamed("row_idx", "_row").withColumnRenamed("pos", "row_idx")
    cell = F.struct("row_idx", F.col(value).alias("v"))
    is_head, is_tail = F.col("row_idx") < window, F.col("row_idx") >= F.col("n") - window
    # Two lists of `window` values per series, whatever its length.
    ends = (
        placed.filter(is_head | is_tail)
        .groupBy("well_id")
        .agg(
            F.max("n").alias("n_rows"),
            F.sort_array(F.collect_list(F.when(is_head, cell))).alias("_head"),
            F.sort_array(F.collect_list(F.when(is_tail, cell))).alias("_tail"),
        )
    )
    blocked = spread(placed, half, half, size).join(per_block(ends, size, "n_rows"), KEYS)

    def shifted(k: int) -> Column:
        return F.lag(value, -k).over(rows()) if k < 0 else (F.col(value) if k == 0 else F.lead(value, k).over(rows()))

    inner = reduce(lambda a, b: a + b, [F.lit(float(c)) * shifted(k - half) for k, c in enumerate(fit[half])])
    table = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in fit])

    def edge(values: str, place: Column) -> Column:
        weights = F.element_at(table, (place + 1).cast("int"))
        terms = F.zip_with(F.col(values), weights, lambda s, w: s["v"] * w)
        return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)

    from_end = F.col("n") - F.col("row_idx")
    out = (
        F.when(F.col("n") <= window, F.col(value))
        .when(F.col("row_idx") < half, edge("_head", F.col("row_idx")))
        .when(from_end <= half, edge("_tail", F.lit(window) - from_end))
        .otherwise(inner)
    )
    blocked = blocked.withColumn("_s", out)
    kept = [c for c in df.columns if c not in (value, "row_idx")]
    return settle(blocked, size).select(
        *[F.col("_row").alias("row_idx"), *kept, F.col("_s").alias(value)]
    ).select(*df.columns)


def clip_bounds(df: DataFrame, value: str = "tvt", pairs=CLIP_PERCENTILES) -> DataFrame:
    """Exact percentile pairs of a column: ``label, lower, upper``; all pairs from one pass."""
    probs = [p / 100 for pair in pairs for p in pair]
    q = quantiles(df.filter(F.col(value).isNotNull()), [], [value], probs)
    rows_ = [
        F.struct(F.lit(f"p{a}-p{b}").alias("label"), F.col(value)[2 * i].alias("lower"), F.col(value)[2 * i + 1].alias("upper"))
        for i, (a, b) in enumerate(pairs)
    ]
    return q.select(F.explode(F.array(*rows_)).alias("b")).select("b.*")


def clip_to(df: DataFrame, bounds: DataFrame, label: str, value: str = "tvt") -> DataFrame:
    one = F.broadcast(bounds.filter(F.col("label") == label).select("lower", "upper"))  # one row
    return df.join(one, how="cross").withColumn(value, clip(F.col(value), F.col("lower"), F.col("upper"))).drop("lower", "upper")


def postprocess(
    df: DataFrame,
    value: str = "tvt",
    window: int | None = None,
    polyorder: int = 2,
    lower: float | None = None,
    upper: float | None = None,
    order: str = "clip_smooth",
    size: int | None = None,
) -> DataFrame:
    """Clip, then smooth, or the other way round; a missing setting skips its step."""
    if order not in ("clip_smooth", "smooth_clip"):
        raise ValueError(f"unknown order: {order}")

    def clipped(d: DataFrame) -> DataFrame:
        if lower is None or upper is None:
            return d
        return d.withColumn(value, clip(F.col(value), lower, upper))

    def smoothed(d: DataFrame) -> DataFrame:
        return d if window is None else smooth(d, value, window, polyorder, size)

    return smoothed(clipped(df)) if order == "clip_smooth" else clipped(smoothed(df))


# --- grid search --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Setting:
    window: int | None = None
    polyorder: int = 0
    lower: float | None = None
    upper: float | None = None
    order: str = "clip_smooth"


BASELINE = Setting(31, 2)


def grid(bounds: list[tuple[float, float]], windows=WINDOWS, polyorders=POLYORDERS) -> list[Setting]:
    """Raw, the default smoother, every smoother, every clip, and every pair of both, without repeats."""
    smoothers = [(w, p) for w in windows for p in polyorders if w > p]
    wanted = [Setting(), BASELINE]
    wanted += [Setting(w, p) for w, p in smoothers]
    valid = [(lo, hi) for lo, hi in bounds if lo < hi]
    wanted += [Setting(None, 0, lo, hi) for lo, hi in valid]
    wanted += [Setting(w, p, lo, hi) for w, p in smoothers for lo, hi in valid]
    return list(dict.fromkeys(wanted))


def apply_setting(v: np.ndarray, s: Setting, pos: np.ndarray, n: int) -> np.ndarray:
    """One setting on a stretch of a series that reaches far enough around the rows of interest."""
    clips = s.lower is not None and s.upper is not None
    if clips and s.order == "clip_smooth":
        v = np.clip(v, s.lower, s.upper)
    if s.window is not None and n > s.window:
        v = _smooth_stretch(v, s.window, s.polyorder, pos, n)
    if clips and s.order == "smooth_clip":
        v = np.clip(v, s.lower, s.upper)
    return v


def _smooth_stretch(v: np.ndarray, window: int, polyorder: int, pos: np.ndarray, n: int) -> np.ndarray:
    half, fit = window // 2, fit_matrix(window, polyorder)
    out = v.copy()
    if len(v) >= window:
        out[half : len(v) - half] = np.correlate(v, fit[half], "valid")
        if pos[0] == 0:
            out[:half] = fit[:half] @ v[:window]
        if pos[-1] == n - 1:
            out[len(v) - half :] = fit[half + 1 :] @ v[-window:]
    return out


def grid_scores(df: DataFrame, settings: list[Setting], size: int | None = None) -> DataFrame:
    """RMSE of every setting on ``(well_id, row_idx, y_true, y_pred, baseline)``, in full target space.

    Blocks are smoothed with all settings at once and leave one partial sum per setting.
    """
    reach = max([s.window for s in settings if s.window] or [1])
    full = df.select(
        "well_id",
        "row_idx",
        (F.col("y_true") + F.col("baseline")).alias("t"),
        (F.col("y_pred") + F.col("baseline")).alias("p"),
    )
    placed = with_position(full, size).drop("row_idx").withColumnRenamed("pos", "row_idx")
    blocked = spread(placed, reach, reach, size)
    block_rows = size or BLOCK_ROWS
    inside = F.col("block") <= F.floor((F.col("n") - 1) / block_rows)

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        pos, n = pdf["row_idx"].to_numpy(), int(pdf["n"].iloc[0])
        home = pos // block_rows == key[1]
        t, p = pdf["t"].to_numpy(float), pdf["p"].to_numpy(float)
        sse = [float(((apply_setting(p, s, pos, n) - t)[home] ** 2).sum()) for s in settings]
        return pd.DataFrame({"setting": np.arange(len(settings)), "sse": sse, "n_rows": int(home.sum())})

    parts = blocked.filter(inside).groupBy(*KEYS).applyInPandas(score, "setting int, sse double, n_rows long")
    return parts.groupBy("setting").agg(F.sqrt(F.sum("sse") / F.sum("n_rows")).alias("rmse"))


def grid_search(
    df: DataFrame, settings: list[Setting], min_delta: float = MIN_DELTA, size: int | None = None
) -> DataFrame:
    """Score all settings, best first, with the gain over raw and over the default, and which one is chosen.

    The default smoother is kept unless the best setting gains at least ``min_delta``.
    """
    spark = df.sparkSession
    names = [(i, s.window, s.polyorder, s.lower, s.upper, s.order) for i, s in enumerate(settings)]
    described = F.broadcast(  # one row per setting
        spark.createDataFrame(
            names, "setting int, window int, polyorder int, lower double, upper double, apply_order string"
        )
    )
    scored = grid_scores(df, settings, size).join(described, "setting")
    raw, default = settings.index(Setting()), settings.index(BASELINE)
    over = Window.partitionBy(F.lit(1))  # one row per setting
    at = {k: F.max(F.when(F.col("setting") == k, F.col("rmse"))).over(over) for k in (raw, default)}
    best = F.min(F.struct("rmse", "setting")).over(over)
    chosen = F.when(at[default] - best["rmse"] < min_delta, F.lit(default)).otherwise(best["setting"])
    return scored.select(
        "setting",
        "window",
        "polyorder",
        "lower",
        "upper",
        "apply_order",
        "rmse",
        (F.col("rmse") - at[raw]).alias("delta_vs_raw"),
        (F.col("rmse") - at[default]).alias("delta_vs_default"),
        (F.col("setting") == chosen).alias("chosen"),
    )


def top_settings(scores: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` best settings, the report the search prints; errors equal to nine digits keep the grid's order."""
    return scores.orderBy(F.round("rmse", 9), "setting").limit(k)
