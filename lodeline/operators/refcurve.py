"""Joins of a series to its reference curve: interpolation, nearest row, band, window match."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.blocks import BLOCK_ROWS, KEYS, frame, is_home, per_block, settle, small_side, spread
from lodeline.functions.scalars import is_finite
from lodeline.operators.anchors import anchors, join_anchors
from lodeline.session import stage

OFFSETS = [-80, -40, -20, -10, -5, 0, 5, 10, 20, 40, 80]
MATCH_BLOCK = 4096
STRETCH = 128


def summary(reference: DataFrame, **extra: Column) -> DataFrame:
    """Per curve: target range in file order, mean and population deviation of the signal.

    A missing signal value anywhere makes mean and deviation NULL.
    """
    complete = F.count("*") == F.count("gr")
    pos = F.col("tw_idx")
    return reference.groupBy("well_id").agg(
        (F.max_by("tvt", pos) - F.min_by("tvt", pos)).alias("tw_range"),
        F.when(complete, F.avg("gr")).alias("tw_gr_mean"),
        F.when(complete, F.stddev_pop("gr")).alias("tw_gr_std"),
        *[e.alias(n) for n, e in extra.items()],
    )


def curve_with(reference: DataFrame, per_series: DataFrame) -> DataFrame:
    """Curve rows with the constants of their series, joined block by block as a curve may be long."""
    rows = reference.groupBy("well_id").agg((F.max("tw_idx") + 1).alias("_m"))
    small = per_block(per_series.join(rows, "well_id"), rows_col="_m").drop("_m")
    blocked = reference.withColumn("block", F.floor(F.col("tw_idx") / BLOCK_ROWS))
    return blocked.join(small_side(small), KEYS).drop("block")


def interpolate_at(reference: DataFrame, points: DataFrame, queries: dict[str, Column]) -> DataFrame:
    """Signal of the curve at each query value, linear between neighbours and constant beyond the ends.

    ``points`` has one row per series; ``queries`` are expressions over its columns. Both neighbours of every
    query value come out of one aggregate over the curve, which combines map-side.
    """
    asked = points.select("well_id", *[q.alias(f"_q{i}") for i, q in enumerate(queries.values())])
    here = F.struct("tvt", "tw_idx", "gr")
    aggs = []
    for i in range(len(queries)):
        q = F.col(f"_q{i}")
        aggs += [
            F.max(q).alias(f"_q{i}"),
            F.max(F.when(F.col("tvt") <= q, here)).alias(f"_lo{i}"),
            F.min(F.when(F.col("tvt") >= q, here)).alias(f"_hi{i}"),
        ]
    found = curve_with(reference, asked).groupBy("well_id").agg(*aggs)

    def lerp(i: int) -> Column:
        lo, hi, q = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_q{i}")
        slope = F.try_divide(hi["gr"] - lo["gr"], hi["tvt"] - lo["tvt"])
        inside = F.when(hi["tvt"] > lo["tvt"], slope * (q - lo["tvt"]) + lo["gr"])
        return F.when(q.isNotNull(), F.coalesce(inside, lo["gr"], hi["gr"]))

    return found.select("well_id", *[lerp(i).alias(name) for i, name in enumerate(queries)])


def interp_asof(df: DataFrame, reference: DataFrame, offsets: list[int] = OFFSETS) -> DataFrame:
    """Curve signal at fixed offsets from the last known target, one column per offset."""
    queries = {_offset_name(o): F.col("last_known") + o for o in offsets}
    return interpolate_at(reference, anchors(df), queries)


def _offset_name(o: int) -> str:
    return f"gr_at_{'m' if o < 0 else 'p'}{abs(o)}"


def nearest_asof(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Curve row nearest to the last known target; the lower row wins a tie."""
    joined = curve_with(reference, anchors(df).select("well_id", "last_known"))
    gap = F.abs(F.col("tvt") - F.col("last_known"))
    return (
        joined.groupBy("well_id")
        .agg(F.min(F.struct(gap.alias("gap"), "tw_idx", "tvt")).alias("m"))
        .select("well_id", "m.tw_idx", "m.tvt", "m.gap")
    )


def band_join(df: DataFrame, reference: DataFrame, half_width: float = 300.0) -> DataFrame:
    """Curve rows within ``half_width`` of the last known target."""
    centre = anchors(df).select("well_id", "last_known")
    near = F.col("tvt").between(F.col("last_known") - half_width, F.col("last_known") + half_width)
    return curve_with(reference, centre).filter(near).select("well_id", "tw_idx", "tvt", "gr")


def residuals(
    df: DataFrame, reference: DataFrame, summary_only: bool = False, size: int | None = None
) -> DataFrame:
    """Signal minus curve signal at each offset, and the curve summary, on every row.

    All columns are 0 in a series without any known target.
    """
    offsets = [] if summary_only else OFFSETS
    queries = {"tw_gr_at_last_tvt": F.col("last_known")} | {_offset_name(o): F.col("last_known") + o for o in offsets}
    curve = summary(reference).join(interpolate_at(reference, anchors(df), queries), "well_id")
    per_series = anchors(df).join(curve, "well_id")
    joined = join_anchors(spread(df, size=size), per_series, size)
    unknown = F.col("last_known").isNull()

    def guarded(c: Column, name: str) -> Column:
        return F.when(unknown, F.lit(0.0)).otherwise(c).alias(name)

    cols = [guarded(F.col("gr") - F.col(_offset_name(o)), f"tw_gr_residual_{_offset_name(o)[6:]}") for o in offsets]
    cols += [guarded(F.col(c), c) for c in ("tw_range", "tw_gr_mean", "tw_gr_std", "tw_gr_at_last_tvt")]
    return joined.select("well_id", "row_idx", *cols)


def formation_signal(reference: DataFrame) -> DataFrame:
    """Mean and deviation of the curve signal per formation, the data-driven form of the fixed score table."""
    return reference.groupBy("geology").agg(
        F.count("gr").alias("n"), F.avg("gr").alias("gr_mean"), F.stddev_samp("gr").alias("gr_std")
    )


# --- window match -----------------------------------------------------------------------------------------


def window_match(
    df: DataFrame,
    reference: DataFrame,
    anchor: str = "anchor",
    window: int = 25,
    band: float = 300.0,
    block: int = MATCH_BLOCK,
) -> DataFrame:
    """Target of the curve window whose signal is closest to the signal around each row from the cut on.

    ``df`` carries the ``anchor`` column. The curve rows whose target lies within ``band`` of the anchor, in the order of the
    curve, make up the windows; a curve may run up and down. Targets are cut into buckets of the band's width: a row meets
    the curve rows of three buckets, by equality. Rows are also cut into blocks and curve rows into chunks, so a
    task holds one of each, however long the series or the curve is. Each pair gives one best start per row, and
    the smallest (distance, start) over pairs wins.
    """
    width = float(band) if band > 0 else 1.0
    per_series = anchors(df).select("well_id", "n", "ps")
    signal = F.coalesce(F.col("gr"), F.lit(0.0))
    # Rows before the first window are seen by none. The others are read three times, so they are written once.
    blocked = stage(
        spread(df.select("well_id", "row_idx", "gr", anchor), window, window, block)
        .join(per_block(per_series, block), KEYS)
        .filter(F.col("row_idx") >= F.col("ps") - window)
        .select(*KEYS, "row_idx", signal.alias("gr"), F.col(anchor).alias("anchor"), "n", "ps")
    )
    searched = is_finite(F.col("anchor")) & (F.col("row_idx") >= F.col("ps")) & is_home(block)
    own = F.when(searched, F.floor(F.col("anchor") / width))
    left = (
        blocked.withColumn("own", own)
        .withColumn("near", F.collect_set("own").over(frame(window, window)))
        .withColumn("bucket", F.explode("near"))
        .select(*KEYS, "bucket", "row_idx", "gr", "anchor", "n", F.coalesce(F.col("own") == F.col("bucket"), F.lit(False)).alias("home"))
    )

    long_enough = reference.groupBy("well_id").agg(F.count("*").alias("m")).filter("m >= 3").select("well_id")
    at, eps = F.col("tvt") / width, 1e-6
    curve = (
        curve_with(reference, long_enough)
        .filter(is_finite(F.col("tvt")))
        .withColumn("bucket", F.explode(F.sequence(F.floor(at - band / width - eps), F.floor(at + band / width + eps))))
        .select("well_id", "bucket", F.floor(F.col("tw_idx") / block).alias("chunk"), "tw_idx", "tvt", signal.alias("gr"))
    )
    # A window that starts in a chunk ends, at the latest, where 2 * window rows have followed that lie in the band of
    # every anchor of the bucket.
    low, high = (F.col("bucket") + 1) * width - band, F.col("bucket") * width + band
    sure = (F.col("tvt") > low + eps * width) & (F.col("tvt") < high - eps * width)
    line = Window.partitionBy("well_id", "bucket")
    chunks = (
        curve.groupBy("well_id", "bucket", "chunk")
        .agg(F.count_if(sure).alias("sure"))
        .withColumn("upto", F.sum("sure").over(line.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("end", F.min("chunk").over(line.orderBy(F.desc("upto")).rangeBetween(Window.unboundedPreceding, -2 * window)))
        .select("well_id", "bucket", "chunk", F.coalesce("end", F.max("chunk").over(line)).alias("end"))
    )
    pairs = left.filter("home").select(*KEYS, "bucket").distinct().join(chunks, ["well_id", "bucket"])
    on = [*KEYS, "bucket", "chunk"]
    # Fresh column ids: both sides come from the same pair table.
    asking = left.join(pairs.select(*on), [*KEYS, "bucket"]).select(*on, "row_idx", "gr", "anchor", "n", "home")
    asking = asking.toDF(*asking.columns)
    parts = pairs.select(*on, F.explode(F.sequence("chunk", "end")).alias("part"))
    answering = curve.withColumnRenamed("chunk", "part").join(parts, ["well_id", "bucket", "part"]).select(*on, "part", "tw_idx", "tvt", "gr")
    answering = answering.toDF(*answering.columns)

    def match(key: tuple, s: pa.Table, c: pa.Table) -> pa.Table:
        by_row, by_place = (np.argsort(t[at].to_numpy()) for t, at in ((s, "row_idx"), (c, "tw_idx")))
        row = s["row_idx"].to_numpy()[by_row]
        home = np.flatnonzero(s["home"].to_numpy()[by_row])
        low = np.maximum(row[home] - window, 0)
        length = np.minimum(row[home] + window + 1, s["n"][0].as_py() if len(s) else 0) - low
        first = np.searchsorted(row, low)  # every row of a home row's window is here
        idx, sad, centre = best_windows(
            s["gr"].to_numpy()[by_row],
            first,
            length,
            s["anchor"].to_numpy()[by_row][home],
            c["gr"].to_numpy()[by_place],
            c["tvt"].to_numpy()[by_place],
            int((c["part"].to_numpy() == key[3].as_py()).sum()),
            band,
        )
        hit = idx >= 0
        return pa.table(
            {
                "well_id": pa.array([key[0].as_py()] * int(hit.sum()), pa.string()),
                "row_idx": pa.array(row[home][hit], pa.int32()),
                "start": pa.array(c["tw_idx"].to_numpy()[by_place][idx[hit]], pa.int32()),
                "sad": sad[hit],
                "centre": centre[hit],
            }
        )

    schema = "well_id string, row_idx int, start int, sad double, centre double"
    partial = asking.groupBy(*on).cogroup(answering.groupBy(*on)).applyInArrow(match, schema)
    best = partial.groupBy("well_id", "row_idx").agg(F.min(F.struct("sad", "start", "centre")).alias("m"))
    target = settle(blocked, block).filter(F.col("row_idx") >= F.col("ps")).select("well_id", "row_idx", "anchor")
    return target.join(best, ["well_id", "row_idx"], "left").select(
        "well_id", "row_idx", F.coalesce(F.col("m.centre"), F.col("anchor")).alias("matched_tvt")
    )


def best_windows(gr, first, length, anchor, cgr, ctvt, starts, band, cells=1 << 21):
    """Per searched row: place of the first start of the closest window, its distance and the target at its centre.

    ``first`` and ``length`` tell each row's window in ``gr``. Only the first ``starts`` curve rows may start a window, those
    behind them complete it. A window is made of curve rows inside the band of the anchor alone. -1 where none fits.
    Where the curve runs one way, the rows of a band follow each other and stretches of rows are compared together; elsewhere
    only rows that see the same curve rows are, ``cells`` values at a time.
    """
    start = np.full(len(anchor), -1)
    sad = np.full(len(anchor), np.inf)
    centre = np.full(len(anchor), np.nan)
    step = np.diff(ctvt)
    if np.isfinite(gr).all() and np.isfinite(cgr).all() and ((step >= 0).all() or (step <= 0).all()):
        way = -1.0 if (step < 0).any() else 1.0
        ends = np.sort([way * (anchor - band), way * (anchor + band)], axis=0)
        begin, end = np.searchsorted(way * ctvt, ends[0], "left"), np.searchsorted(way * ctvt, ends[1], "right")
        last = np.minimum(starts, end - length + 1)  # a start has to be before
        searched = np.flatnonzero((length >= 3) & (last > begin))
        searched = searched[np.argsort(first[searched], kind="stable")]
        edges = np.flatnonzero(np.diff(first[searched] // STRETCH)) + 1
        for part in np.split(searched, edges) if len(searched) else []:
            start[part], sad[part] = _stretch_windows(gr, first[part], length[part], cgr, begin[part], last[part], cells)
        centre[searched] = ctvt[start[searched] + length[searched] // 2]
        return start, sad, centre
    values = np.sort(ctvt)
    seen = np.stack([np.searchsorted(values, anchor - band, "left"), np.searchsorted(values, anchor + band, "right"), length])
    order = np.lexsort(seen)
    order = order[(seen[2] >= 3)[order]]
    edges = np.flatnonzero(np.any(np.diff(seen[:, order], axis=1) != 0, axis=0)) + 1
    for group in np.split(order, edges):
        if not len(group):
            continue
        size, a = length[group[0]], anchor[group[0]]
        members = np.flatnonzero((ctvt >= a - band) & (ctvt <= a + band))
        count = min(np.searchsorted(members, starts), len(members) - size + 1)
        if count < 1:
            continue
        windows = np.lib.stride_tricks.sliding_window_view(cgr[members], size)[:count]
        step = max(1, cells // (count * size))
        for k in range(0, len(group), step):
            part = group[k : k + step]
            mine = gr[first[part][:, None] + np.arange(size)]
            dist = np.abs(windows[None, :, :] - mine[:, None, :]).sum(axis=2)
            best = dist.argmin(axis=1)
            sad[part] = dist[np.arange(len(part)), best]
            start[part] = members[best]
            centre[part] = ctvt[members[best + size // 2]]
    return start, sad, centre


def _stretch_windows(gr, first, length, cgr, begin, last, cells):
    """Place and distance of the first closest window of each row of a stretch, with starts in ``begin`` to ``last``.

    Distances along a diagonal of (row, curve row) are differences of its running sum. That is exact but for rounding, so it
    only tells which starts can be the closest; their distances are then summed value by value.
    """
    row0, col0 = first.min(), begin.min()
    x, y = gr[row0 : (first + length).max()], cgr[col0 : (last + length - 1).max()]
    n, width = len(x), len(x) + len(y) - 1
    # Cell (i, j) is kept in column j - i + n - 1, so that a diagonal is a column.
    sums = np.zeros((n + 1, width))
    flat = sums[1:].reshape(-1)[n - 1 :]
    cell = np.lib.stride_tricks.as_strided(flat, (n, len(y)), ((width - 1) * flat.itemsize, flat.itemsize))
    np.abs(np.subtract(x[:, None], y[None, :], out=cell), out=cell)
    np.cumsum(sums, axis=0, out=sums)
    slack = 8 * n * np.finfo(float).eps * sums[-1].max()
    at, place = first - row0, np.arange(last.max() - col0)
    column = place + (n - 1 - at)[:, None]
    near = np.take_along_axis(sums[at + length], column, axis=1) - np.take_along_axis(sums[at], column, axis=1)
    near[(place < (begin - col0)[:, None]) | (place >= (last - col0)[:, None])] = np.inf
    row, start = np.nonzero(near <= near.min(axis=1)[:, None] + slack)
    dist = np.empty(len(row))
    for size in np.unique(length):
        mine = np.flatnonzero(length[row] == size)
        for k in range(0, len(mine), max(1, cells // size)):
            some, along = mine[k : k + max(1, cells // size)], np.arange(size)
            dist[some] = np.abs(x[at[row[some]][:, None] + along] - y[start[some][:, None] + along]).sum(axis=1)
    order = np.lexsort((start, dist, row))
    best = order[np.searchsorted(row[order], np.arange(len(first)))]
    return col0 + start[best], dist[best]
