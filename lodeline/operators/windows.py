"""Per-series window features.

A family lists how far its frames reach, the series constants it reads, and its columns in steps: the columns of
one step may read those of the step before. Families that are asked for together share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.blocks import (
    KEYS,
    block_of,
    earlier_blocks,
    frame,
    is_home,
    later_blocks,
    onward,
    per_block,
    rows,
    running,
    settle,
    small_side,
    spread,
)
from lodeline.functions.scalars import clip, safe_divide
from lodeline.operators.anchors import anchors, named_extra

ROLL_WINDOW = 101
ROLL_WINDOWS = [5, 21, 51, 101]
LAGS = [1, 5, 15, 30]
DIP_STEP = 10
TORTUOSITY_STEP = 50
# Mean and standard deviation of the signal per formation.
FORMATION_SIGNAL = {
    "egfdl": (93.0, 22.2),
    "buda": (41.4, 15.4),
    "mnss": (131.1, 27.5),
    "egfdu": (69.5, 15.8),
    "astnl": (53.7, 24.2),
    "lthl": (84.0, 14.6),
    "ltgt": (75.3, 10.4),
    "clayrich": (120.9, 26.8),
}
SEQUENCE_COLUMNS = ["x", "y", "z", "gr", "md"]
SEQUENCE_LAGS = [1, 2, 3, 5]
SEQUENCE_WINDOWS = [3, 5, 10]


@dataclass
class Family:
    outputs: list[str]
    steps: list[dict[str, Column]]
    before: int = 0
    after: int = 0
    # Aggregates per series, and running values carried from earlier blocks, both by name.
    needs: dict[str, Column] = field(default_factory=dict)
    carry: dict[str, tuple[Column, Callable[[str], Column]]] = field(default_factory=dict)
    # Further per-series tables keyed by ``well_id``.
    tables: list[Callable[..., DataFrame]] = field(default_factory=list)


def build(df: DataFrame, families: list[Family], keep: list[str] = (), size: int | None = None) -> DataFrame:
    """The columns of all families next to ``(well_id, row_idx)`` and the ``keep`` columns."""
    before = max(f.before for f in families)
    after = max(f.after for f in families)
    blocked = spread(df, before, after, size)
    needs = {n: e for f in families for n, e in f.needs.items()}
    tables = {t for f in families for t in f.tables}
    if needs or tables:
        per_series = anchors(df, **needs)
        for make in sorted(tables, key=lambda t: t.__name__):
            per_series = per_series.join(make(df, size), "well_id", "left")
        blocked = blocked.join(per_block(per_series, size), KEYS)
    carry = {n: c for f in families for n, c in f.carry.items()}
    if carry:
        blocked = blocked.join(small_side(_carried(df, carry, before, size)), KEYS)
    for depth in range(max(len(f.steps) for f in families)):
        level = {n: c for f in families if depth < len(f.steps) for n, c in f.steps[depth].items()}
        blocked = blocked.withColumns(level)
    outputs = [c for f in families for c in f.outputs]
    return settle(blocked, size).select("well_id", "row_idx", *keep, *outputs)


def _carried(
    df: DataFrame, carry: dict[str, tuple[Column, Callable[[str], Column]]], before: int, size: int | None
) -> DataFrame:
    """Per block, values accumulated over all rows that come before the block and its halo."""
    totals = df.groupBy("well_id", block_of(size, before).alias("block")).agg(
        *[agg.alias(n) for n, (agg, _) in carry.items()]
    )
    # A block may be missing from the totals when only halo rows fall in it, so the carry is taken from the
    # blocks present and looked up for each block of the series.
    every = per_block(df.groupBy("well_id").agg((F.max("row_idx") + 1).alias("n")), size).drop("n")
    joined = every.join(totals, KEYS, "left")
    return joined.select(*KEYS, *[combine(n).over(earlier_blocks()).alias(n) for n, (_, combine) in carry.items()])


# --- families ---------------------------------------------------------------------------------------------


def base() -> Family:
    span = F.col("md_max") - F.col("md_min")
    rel = F.when(span > 0, F.try_divide(F.col("md") - F.col("md_min"), span)).otherwise(0.0)
    return Family(["md_relative"], [{"md_relative": rel}], needs={n: named_extra(n) for n in ("md_min", "md_max")})


def geometry() -> Family:
    since = F.col("row_idx") - F.col("ps")
    tail = F.col("n") - F.col("ps")
    names = {"md": "md_since_ps", "x": "dx_since_ps", "y": "dy_since_ps", "z": "dz_since_ps"}
    offsets = {name: F.col(c) - F.col(f"{c}_cut") for c, name in names.items()}
    slopes = {}
    for c in ("x", "y", "z"):
        step = F.col("md") - F.lag("md").over(rows())
        slopes[f"d{c}dmd"] = safe_divide(F.col(c) - F.lag(c).over(rows()), step, 0.0)
    frac = F.when((since >= 0) & (tail > 1), F.try_divide(since, tail - 1)).otherwise(0.0)
    dx, dy = F.col("dx_since_ps"), F.col("dy_since_ps")
    return Family(
        [*offsets, "dxy_since_ps", "frac_after_ps", *slopes],
        [{**offsets, **slopes, "frac_after_ps": frac}, {"dxy_since_ps": F.sqrt(dx * dx + dy * dy)}],
        before=1,
        needs={n: named_extra(n) for n in ("md_cut", "x_cut", "y_cut", "z_cut")},
    )


def rolling(windows: list[int] = ROLL_WINDOWS) -> Family:
    cols = {}
    for w in windows:
        around = frame(w // 2, w // 2)
        cols[f"gr_roll_mean_{w}"] = F.coalesce(F.avg("gr").over(around), F.lit(0.0))
        cols[f"gr_roll_std_{w}"] = F.coalesce(F.stddev_samp("gr").over(around), F.lit(0.0))
    half = max(windows) // 2
    return Family(list(cols), [cols], before=half, after=half)


def lag_lead() -> Family:
    def at(k: int) -> Column:
        return F.lag("gr", k).over(rows()) if k > 0 else F.lead("gr", -k).over(rows())

    cols = {f"gr_lag_{k}": F.coalesce(at(k), F.lit(0.0)) for k in LAGS}
    cols |= {f"gr_lead_{k}": F.coalesce(at(-k), F.lit(0.0)) for k in LAGS}
    cols["gr_d1"] = F.coalesce(F.col("gr") - at(1), F.lit(0.0))
    cols["gr_d2"] = F.coalesce((F.col("gr") - at(1)) - (at(1) - at(2)), F.lit(0.0))
    return Family(list(cols), [cols], before=max(LAGS), after=max(LAGS))


def cumulative_energy() -> Family:
    squares = F.col("gr") * F.col("gr")
    total = F.coalesce(F.col("carry_sq"), F.lit(0.0)) + F.coalesce(F.sum(squares).over(running()), F.lit(0.0))
    seen = F.coalesce(F.col("carry_count"), F.lit(0)) + F.count("gr").over(running())
    return Family(
        ["gr_energy"],
        [{"gr_energy": total / F.greatest(seen, F.lit(1))}],
        carry={"carry_sq": (F.sum(squares), F.sum), "carry_count": (F.count("gr"), F.sum)},
    )


def envelope() -> Family:
    around = frame(10, 10)
    return Family(
        ["gr_envelope"],
        [{"gr_envelope": F.max("gr").over(around) - F.min("gr").over(around)}],
        before=10,
        after=10,
    )


def z_drift() -> Family:
    anchor = F.col("last_known")
    offset = anchor - F.col("z_cut")
    implied = F.col("z") + offset
    cols = {
        "z_drift_offset_at_anchor": F.coalesce(offset, F.lit(0.0)),
        "z_drift_implied_tvt": F.coalesce(implied, F.lit(0.0)),
        "z_drift_implied_tvt_resid": F.coalesce(clip(implied - anchor, -100.0, 100.0), F.lit(0.0)),
    }
    return Family(list(cols), [cols], needs={"z_cut": named_extra("z_cut")})


def z_physics() -> Family:
    value = F.when(F.col("row_idx") >= F.col("ps"), F.col("z") + (F.col("last_known") - F.col("z_cut")))
    return Family(["z_physics"], [{"z_physics": value}], needs={"z_cut": named_extra("z_cut")})


def trajectory() -> Family:
    step = {c: F.col(c) - F.coalesce(F.lag(c).over(rows()), F.col(c)) for c in ("x", "y", "z")}

    def back(c: str, k: int) -> Column:
        return F.coalesce(F.lag(c, k).over(rows()), F.col(f"{c}_first"))

    dmd = F.col("md") - back("md", DIP_STEP)
    dip = F.when(F.abs(dmd) > 1e-9, F.try_divide(F.col("z") - back("z", DIP_STEP), dmd)).otherwise(0.0)
    chord = F.sqrt(sum(((F.col(c) - back(c, TORTUOSITY_STEP)) ** 2 for c in ("x", "y", "z")), F.lit(0.0)))
    ds = F.sqrt(step["x"] ** 2 + step["y"] ** 2 + step["z"] ** 2)
    arc = F.sum("_ds").over(frame(TORTUOSITY_STEP - 1, 0))
    tort = F.when((F.col("_chord") > 1e-9) & (arc > 0), F.try_divide(arc, F.col("_chord"))).otherwise(1.0)
    azimuth = F.atan2(step["y"], step["x"])
    return Family(
        ["z_local_delta", "dip_angle_proxy_10", "tortuosity_window_50", "sin_azimuth", "cos_azimuth"],
        [
            {
                "z_local_delta": F.col("z") - F.col("z_mean_before"),
                "dip_angle_proxy_10": dip,
                "sin_azimuth": F.sin(azimuth),
                "cos_azimuth": F.cos(azimuth),
                "_ds": ds,
                "_chord": chord,
            },
            {"tortuosity_window_50": tort},
        ],
        before=TORTUOSITY_STEP,
        needs={f"{c}_first": F.min_by(c, F.col("row_idx")) for c in ("md", "x", "y", "z")},
        tables=[mean_before_cut],
    )


def mean_before_cut(df: DataFrame, size: int | None = None) -> DataFrame:
    """Per series, mean ``z`` of the rows before the cut, or of all rows when the cut is the first row."""
    rows_with_cut = spread(df, size=size).join(per_block(anchors(df), size), KEYS)
    counted = (F.col("row_idx") < F.col("ps")) | (F.col("ps") == 0)
    return rows_with_cut.groupBy("well_id").agg(F.avg(F.when(counted, F.col("z"))).alias("z_mean_before"))


def formation_zscores() -> Family:
    signal = F.coalesce(F.col("gr"), F.lit(0.0))
    cols = {f"geol_gr_zscore_{f}": (signal - mean) / (std + 1e-6) for f, (mean, std) in FORMATION_SIGNAL.items()}
    return Family(
        [*cols, "geol_gr_zscore_roll20"],
        [cols, {"geol_gr_zscore_roll20": F.avg("geol_gr_zscore_egfdl").over(frame(19, 0))}],
        before=19,
    )


def sequence(causal: bool = False) -> Family:
    """Gap-filled inputs, differences, lags and trailing statistics of the five raw columns.

    ``causal`` leaves leading gaps at zero instead of filling them from later rows.
    """
    filled, first, needs, carry, derived, outputs = {}, {}, {}, {}, {}, []
    for c in SEQUENCE_COLUMNS:
        at = F.when(F.col(c).isNotNull(), F.col("row_idx"))
        if not causal:
            needs[f"{c}_earliest"] = F.min_by(c, at)
        carry[f"{c}_carry"] = (F.max_by(c, at), lambda n: F.last(n, ignorenulls=True))
        lead_fill = F.lit(0.0) if causal else F.coalesce(F.col(f"{c}_earliest"), F.lit(0.0))
        filled[f"{c}_fill"] = F.coalesce(F.last(c, ignorenulls=True).over(running()), F.col(f"{c}_carry"), lead_fill)
        v = F.col(f"{c}_fill")
        lagged = F.lag(v, 1).over(rows())
        # The first row takes its own value, but only when a second row exists.
        first[f"{c}_prev"] = F.coalesce(lagged, F.when(F.col("n") > 1, v))
        outputs += [f"{c}_fill", f"{c}_diff1", f"{c}_diff2"]
        derived[f"{c}_diff1"] = F.coalesce(v - lagged, F.lit(0.0))
        derived[f"{c}_diff2"] = F.coalesce(v - F.lag(v, 2).over(rows()), F.lit(0.0))
        for k in SEQUENCE_LAGS:
            derived[f"{c}_lag{k}"] = F.coalesce(F.lag(v, k).over(rows()), F.lit(0.0))
            outputs.append(f"{c}_lag{k}")
        for w in SEQUENCE_WINDOWS:
            trail = frame(w - 1, 0)
            derived[f"{c}_roll_mean{w}"] = F.coalesce(F.avg(f"{c}_prev").over(trail), F.lit(0.0))
            derived[f"{c}_roll_std{w}"] = F.coalesce(F.stddev_samp(f"{c}_prev").over(trail), F.lit(0.0))
            outputs += [f"{c}_roll_mean{w}", f"{c}_roll_std{w}"]
    needs.setdefault("series_rows", F.count("*"))
    return Family(
        outputs, [filled, first, derived], before=max(SEQUENCE_WINDOWS) + 1, needs=needs, carry=carry
    )


# --- gaps -------------------------------------------------------------------------------------------------


def interpolate_gaps(
    df: DataFrame, fallback: DataFrame | None = None, radius: int = 0, size: int | None = None
) -> DataFrame:
    """Signal with gaps filled linearly by row position, ends by the nearest value, then a centred mean.

    ``fallback`` is ``(well_id, fill)`` for series without any value. Returns ``gr_filled`` and ``gr_smooth``.
    """
    at = F.when(F.col("gr").isNotNull(), F.col("row_idx"))
    known = F.when(F.col("gr").isNotNull(), F.struct("row_idx", "gr"))
    every = per_block(anchors(df, **{"_first": F.min_by("gr", at), "_last": F.max_by("gr", at)}), size)
    if fallback is not None:
        every = every.join(fallback, "well_id", "left")
    else:
        every = every.withColumn("fill", F.lit(None).cast("double"))
    # Nearest known row before the halo of a block and after it, from one row per block.
    back = df.groupBy("well_id", block_of(size, radius).alias("block")).agg(F.max(known).alias("_b"))
    ahead = df.groupBy("well_id", F.greatest(block_of(size, -radius), F.lit(0).cast("bigint")).alias("block")).agg(
        F.min(known).alias("_a")
    )
    every = (
        every.join(back, KEYS, "left")
        .join(ahead, KEYS, "left")
        .withColumn("_b", F.last("_b", ignorenulls=True).over(earlier_blocks()))
        .withColumn("_a", F.last("_a", ignorenulls=True).over(later_blocks()))
    )
    prev = F.coalesce(F.last(known, ignorenulls=True).over(running()), F.col("_b"))
    nxt = F.coalesce(F.last(known, ignorenulls=True).over(onward()), F.col("_a"))
    work = spread(df, radius, radius, size).join(small_side(every), KEYS).withColumns({"_p": prev, "_n": nxt})
    share = F.try_divide(F.col("row_idx") - F.col("_p.row_idx"), F.col("_n.row_idx") - F.col("_p.row_idx"))
    lerp = F.col("_p.gr") + (F.col("_n.gr") - F.col("_p.gr")) * share
    work = work.withColumn("gr_filled", F.coalesce(F.col("gr"), lerp, F.col("_first"), F.col("fill")))
    edge = F.when(F.col("gr").isNull() & F.col("_n").isNull(), F.col("_last"))
    work = work.withColumn("gr_filled", F.coalesce(edge, F.col("gr_filled")))
    work = work.withColumn("gr_smooth", F.avg("gr_filled").over(frame(radius, radius)))
    return settle(work, size).select("well_id", "row_idx", "gr_filled", "gr_smooth")


# --- target derivative ------------------------------------------------------------------------------------


def target_derivative(df: DataFrame, size: int | None = None) -> DataFrame:
    """Forward difference of the target over position; the last row repeats the one before it."""
    blocked = spread(df, 1, 1, size).join(per_block(anchors(df), size), KEYS)
    step = F.lead("md").over(rows()) - F.col("md")
    slope = F.when(step > 1e-9, F.try_divide(F.lead("tvt").over(rows()) - F.col("tvt"), step)).otherwise(0.0)
    last = F.col("row_idx") == F.col("n") - 1
    blocked = blocked.withColumn("_d", slope)
    out = blocked.withColumn("dtvt_dmd", F.when(last, F.coalesce(F.lag("_d").over(rows()), F.lit(0.0))).otherwise(F.col("_d")))
    return settle(out, size).select("well_id", "row_idx", "md", "tvt_input", "dtvt_dmd")


def integrate_derivative(df: DataFrame, slope: str, start: str, size: int | None = None) -> DataFrame:
    """Running integral of ``slope`` over ``md`` within each series, from the constant ``start``.

    ``df`` holds the rows to integrate; ``row_idx`` may begin anywhere but has no gaps inside a series. The first
    row moves by the step to the second one.
    """
    blocked = spread(df, 1, 1, size)
    prev, nxt = F.lag("md").over(rows()), F.lead("md").over(rows())
    step = F.when(prev.isNotNull(), F.col("md") - prev).otherwise(F.coalesce(nxt - F.col("md"), F.lit(0.0)))
    steps = blocked.withColumn("_inc", F.col(slope) * step).filter(is_home(size))
    totals = steps.groupBy(*KEYS).agg(F.sum("_inc").alias("_t"))
    carry = totals.select(*KEYS, F.coalesce(F.sum("_t").over(earlier_blocks()), F.lit(0.0)).alias("_c"))
    out = steps.join(small_side(carry), KEYS).withColumn(
        "tvt_integrated", F.col(start) + F.col("_c") + F.sum("_inc").over(running())
    )
    return out.select("well_id", "row_idx", "tvt_integrated")


# --- arrays and padding -----------------------------------------------------------------------------------


def sliding_windows(df: DataFrame, window: int, stride: int, cols: list[str], label: str, size: int | None = None) -> DataFrame:
    """One row per window start ``t = 0, stride, ...`` that fits: arrays of ``cols`` and the last row's ``label``."""
    trail = frame(window - 1, 0)
    # Structs keep the NULLs that collect_list would drop.
    packed = F.collect_list(F.struct(*cols)).over(trail)
    out = settle(spread(df, window - 1, 0, size).withColumn("_w", packed), size)
    start = F.col("row_idx") - (window - 1)
    return out.filter((start >= 0) & (start % stride == 0)).select(
        "well_id", start.alias("start"), *[F.col(f"_w.{c}").alias(c) for c in cols], F.col(label).alias("label")
    )


def pad_head(df: DataFrame, window: int, size: int | None = None) -> DataFrame:
    """Predictions of a windowed model: the rows before the first full window repeat its prediction.

    A series shorter than the window gets 0.
    """
    per = df.groupBy("well_id").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("row_idx") == window - 1, F.col("pred"))).alias("_first")
    )
    rows_in = spread(df, size=size).join(per_block(per, size), KEYS)
    filled = F.when(F.col("row_idx") < window - 1, F.col("_first")).otherwise(F.col("pred"))
    return rows_in.select("well_id", "row_idx", F.coalesce(filled, F.lit(0.0)).alias("pred"))


def series_zscore(df: DataFrame, cols: list[str], size: int | None = None) -> DataFrame:
    """Each column minus its series mean over its population deviation; a constant column is only centred."""
    aggs = [e for c in cols for e in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]
    per = df.groupBy("well_id").agg(F.count("*").alias("n"), *aggs)
    rows_in = spread(df, size=size).join(per_block(per, size), KEYS)

    def scaled(c: str) -> Column:
        s = F.when(F.col(f"{c}_s") < 1e-8, F.lit(1.0)).otherwise(F.col(f"{c}_s"))
        return ((F.col(c) - F.col(f"{c}_m")) / s).alias(f"{c}_z")

    return rows_in.select("well_id", "row_idx", *[scaled(c) for c in cols])


def continuity(df: DataFrame, value: str, limit: float = 30.0, show: int = 10, size: int | None = None) -> DataFrame:
    """Per series: largest and mean absolute jump, how many exceed ``limit``, and the first rows that do."""
    jumps = settle(
        spread(df, 1, 0, size).withColumn("jump", F.abs(F.col(value) - F.lag(value).over(rows()))), size
    ).filter("jump IS NOT NULL")
    over = F.col("jump") > limit
    totals = jumps.groupBy("well_id").agg(
        F.max("jump").alias("max_jump"),
        F.avg("jump").alias("mean_jump"),
        F.count(F.when(over, 1)).alias("n_over"),
    )
    # The smallest row numbers, block by block first, so no list grows with the series.
    firsts = jumps.filter(over).withColumn("block", block_of(size))
    in_block = firsts.withColumn("_r", F.row_number().over(rows())).filter(F.col("_r") <= show)
    per_series = Window.partitionBy("well_id").orderBy("row_idx")
    first_rows = (
        in_block.withColumn("_r", F.row_number().over(per_series))
        .filter(F.col("_r") <= show)
        .groupBy("well_id")
        .agg(F.array_join(F.sort_array(F.collect_list("row_idx")), ",").alias("first_over"))
    )
    return totals.join(first_rows, "well_id", "left").withColumn("first_over", F.coalesce("first_over", F.lit("")))
