"""Errors of predictions: overall, by fold, position, length and series, and reports built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions.blocks import KEYS, per_block, spread
from lodeline.functions.quantiles import bin_right_closed, medians, quantile_edges, quantiles
from lodeline.functions.scalars import correlation, is_finite, rmse_of
from lodeline.operators.anchors import anchors, join_anchors

# Fixed values of the range report.
REPORT_PERCENTILES = [0.01, 0.1, 0.5, 1, 5, 25, 50, 75, 95, 99, 99.5, 99.9, 99.99]
REPORT_BOUNDS = [(0.1, 99.9), (0.5, 99.5), (1.0, 99.0)]


def rmse(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row with the error; an empty input or a value that is not finite is an error."""
    ok = is_finite(F.col(y_true)) & is_finite(F.col(y_pred))
    one = df.agg(
        rmse_of(F.col(y_true), F.col(y_pred)).alias("rmse"),
        F.count("*").alias("n"),
        F.count(F.when(~ok, 1)).alias("bad"),
    )
    problem = F.when(F.col("n") == 0, F.raise_error(F.lit("rmse of no rows"))).when(
        F.col("bad") > 0, F.raise_error(F.lit("rmse of values that are not finite"))
    )
    return one.select(F.coalesce(problem.cast("double"), F.col("rmse")).alias("rmse"), "n")


def naive_validation(df: DataFrame, size: int | None = None) -> DataFrame:
    """Error of the last-known rule over the rows from the cut on: ``rmse, n_rows, n_wells``."""
    per_series = anchors(df).filter("has_cut AND last_known IS NOT NULL")
    rows = join_anchors(spread(df.select("well_id", "row_idx", "tvt"), size=size), per_series, size)
    used = rows.filter((F.col("row_idx") >= F.col("ps")) & F.col("tvt").isNotNull())
    per = used.groupBy("well_id").agg(
        F.sum((F.col("tvt") - F.col("last_known")) ** 2).alias("sse"), F.count("*").alias("n")
    )
    return per.agg(
        F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"), F.sum("n").alias("n_rows"), F.count("*").alias("n_wells")
    )


def fallback_median(df: DataFrame, value: str = "tvt") -> DataFrame:
    """Median of all known targets, the constant for a series without anchor."""
    return quantiles(df.filter(F.col(value).isNotNull()), [], [value], [0.5]).select(
        F.col(value)[0].alias("fallback")
    )


def range_report(df: DataFrame, value: str = "tvt") -> DataFrame:
    """Extent, moments and percentiles of a column, and the share outside each pair of bounds: ``name, value``."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    probs = [p / 100 for p in REPORT_PERCENTILES]
    q = F.broadcast(quantiles(rows, [], ["v"], probs).withColumnRenamed("v", "q"))  # one row
    at = {p: F.col("q")[i] for i, p in enumerate(REPORT_PERCENTILES)}
    shares = [
        (F.avg(((F.col("v") < at[lo]) | (F.col("v") > at[hi])).cast("double")) * 100).alias(f"outside_p{lo}_p{hi}")
        for lo, hi in REPORT_BOUNDS
    ]
    one = rows.join(q, how="cross").agg(
        F.count("*").cast("double").alias("count"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        *shares,
        F.first("q").alias("q"),
    )
    names = [c for c in one.columns if c != "q"]
    lines = [F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in names]
    lines += [F.struct(F.lit(f"p{p}").alias("name"), at[p].alias("value")) for p in REPORT_PERCENTILES]
    return one.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def cv_summary(by_fold: DataFrame, value: str = "rmse") -> DataFrame:
    return by_fold.agg(
        F.avg(value).alias("rmse_mean"), F.stddev_pop(value).alias("rmse_std"), F.count("*").alias("n_folds")
    )


# --- out-of-fold diagnostics ------------------------------------------------------------------------------


def with_position(oof: DataFrame, series: DataFrame, size: int | None = None) -> DataFrame:
    """Add where a row lies after its cut; a series without a cut gives NULL, -1 and 0."""
    per = anchors(series).select("well_id", "n", "ps", "has_cut")
    spread_oof = spread(oof, size=size)
    rows = spread_oof.join(per_block(per, size), KEYS).drop("block")
    tail = F.when(F.col("has_cut"), F.col("n") - F.col("ps")).otherwise(F.lit(0))
    since = F.col("row_idx") - F.col("ps")
    return rows.select(
        *oof.columns,
        F.when(F.col("has_cut"), since / F.greatest(tail - 1, F.lit(1))).alias("frac_after_ps"),
        F.when(F.col("has_cut"), since).otherwise(F.lit(-1)).cast("int").alias("rows_since_ps"),
        tail.cast("int").alias("well_post_ps_length"),
    )


def _series_errors(oof: DataFrame, *by: str) -> DataFrame:
    """Squared error and rows per series (and ``by``): the small table most reports are built from."""
    return oof.groupBy("well_id", *by).agg(
        F.sum((F.col("y_true") - F.col("y_pred")) ** 2).alias("sse"), F.count("*").alias("n")
    )


def _pooled() -> Column:
    return F.round(F.sqrt(F.sum("sse") / F.sum("n")), 4)


def rmse_by_fold(oof: DataFrame) -> DataFrame:
    # The baseline is added to both sides, so the full-space error differs only by rounding; it is computed all
    # the same, as the report promises both.
    full = (F.col("y_true") + F.col("baseline")) - (F.col("y_pred") + F.col("baseline"))
    per = oof.filter("fold IS NOT NULL").groupBy("fold", "well_id").agg(
        F.sum((F.col("y_true") - F.col("y_pred")) ** 2).alias("sse"),
        F.sum(full * full).alias("sse_full"),
        F.count("*").alias("n"),
    )
    return per.groupBy("fold").agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_wells"),
        _pooled().alias("rmse_delta"),
        F.round(F.sqrt(F.sum("sse_full") / F.sum("n")), 4).alias("rmse_full"),
    )


def rmse_by_position(placed: DataFrame, bins: int = 10) -> DataFrame:
    """Error in equal-width bins of the position after the cut, and over the first and last rows.

    Bins are right-closed over the observed range, whose lower end belongs to the first bin. A row can count in
    one bin and in several of the special groups; it is multiplied only inside the map side of the aggregate.
    """
    valid = placed.filter("frac_after_ps IS NOT NULL")
    span = valid.agg(F.min("frac_after_ps").alias("_lo"), F.max("frac_after_ps").alias("_hi"))
    frac, length = F.col("frac_after_ps"), F.greatest(F.col("well_post_ps_length"), F.lit(1))
    width = (F.col("_hi") - F.col("_lo")) / bins
    edges = F.array(*[F.col("_lo") + width * k for k in range(1, bins)])
    # Only the inner edges matter: whatever is not above the first one is in bin 0.
    bin_no = F.size(F.filter(edges, lambda e: e < frac))
    group = F.array_compact(
        F.array(
            F.format_string("bin_%02d", bin_no),
            F.when(F.col("rows_since_ps") < 5, F.lit("first_5")),
            F.when(F.col("rows_since_ps") < 10, F.lit("first_10")),
            F.when(frac > 1.0 - 5.0 / length, F.lit("last_5")),
            F.when(frac > 1.0 - 10.0 / length, F.lit("last_10")),
        )
    )
    rows = valid.join(F.broadcast(span), how="cross").select(  # one row of observed range
        F.explode(group).alias("grp"), "frac_after_ps", ((F.col("y_true") - F.col("y_pred")) ** 2).alias("se")
    )
    out = rows.groupBy("grp").agg(
        F.min("frac_after_ps").alias("lo"),
        F.max("frac_after_ps").alias("hi"),
        F.count("*").alias("n_rows"),
        F.round(F.sqrt(F.avg("se")), 4).alias("rmse_delta"),
    )
    label = F.when(
        F.col("grp").startswith("bin_"), F.format_string("[%.2f-%.2f)", F.col("lo"), F.col("hi"))
    ).otherwise(F.concat(F.lit("* "), F.col("grp")))
    return out.select("grp", label.alias("frac_bin"), "n_rows", "rmse_delta")


def rmse_by_length(placed: DataFrame, bins: int = 5) -> DataFrame:
    """Error by equal-count bins of the series' unknown length, repeated edges dropped."""
    per = placed.filter("well_post_ps_length > 0").groupBy("well_id").agg(
        F.max("well_post_ps_length").cast("double").alias("len"),
        F.sum((F.col("y_true") - F.col("y_pred")) ** 2).alias("sse"),
        F.count("*").alias("n"),
    )
    edges = quantiles(per, [], ["len"], quantile_edges(bins)).select(F.array_distinct("len").alias("edges"))
    binned = per.join(F.broadcast(edges), how="cross").withColumn(  # one row of edges
        "bin", bin_right_closed(F.col("len"), F.col("edges"))
    )
    return binned.groupBy("bin").agg(
        F.count("*").alias("n_wells"), F.sum("n").alias("n_rows"), _pooled().alias("rmse_delta")
    )


def _dispersion_per_series(oof: DataFrame) -> DataFrame:
    t, p = F.stddev_pop("y_true"), F.stddev_pop("y_pred")
    ratio = F.when(t > 1e-8, F.try_divide(p, t)).otherwise(0.0)
    return oof.groupBy("well_id").agg(ratio.alias("ratio"), F.count("*").alias("n"))


def dispersion(oof: DataFrame) -> DataFrame:
    """Spread of predictions against the spread of targets, overall and per series."""
    t, p = F.stddev_pop("y_true"), F.stddev_pop("y_pred")
    overall = oof.agg(
        F.round(t, 2).alias("target_std"),
        F.round(p, 2).alias("pred_std"),
        F.round(F.when(t > 1e-8, F.try_divide(p, t)).otherwise(0.0), 4).alias("std_ratio"),
        F.round(F.avg("y_true"), 2).alias("target_mean"),
        F.round(F.avg("y_pred"), 2).alias("pred_mean"),
    )
    per = _dispersion_per_series(oof)
    mid = medians(per, [], ["ratio"]).select(F.round("ratio", 4).alias("per_well_ratio_median"))
    flat = F.count(F.when((F.col("ratio") < 0.5) & (F.col("n") > 10), 1))
    rest = per.agg(F.round(F.stddev_pop("ratio"), 4).alias("per_well_ratio_std"), flat.alias("n_flattening_wells"))
    return overall.join(F.broadcast(mid), how="cross").join(F.broadcast(rest), how="cross")  # one row each


def flattening_wells(oof: DataFrame, show: int = 10) -> DataFrame:
    """The first few series, by name, whose predictions vary less than half as much as their targets."""
    per = _dispersion_per_series(oof)
    return per.filter((F.col("ratio") < 0.5) & (F.col("n") > 10)).orderBy("well_id").limit(show).select("well_id", "ratio")


def join_oof(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both tables predict, with the errors of each."""
    key = ["well_id", "row_idx"]
    left = a.select(*key, F.col("y_true").alias("y_true_a"), F.col("y_pred").alias("y_pred_a"))
    right = b.select(*key, F.col("y_true").alias("y_true_b"), F.col("y_pred").alias("y_pred_b"))
    return left.join(right, key).select(
        *key,
        "y_true_a",
        "y_pred_a",
        "y_true_b",
        "y_pred_b",
        (F.col("y_pred_a") - F.col("y_true_a")).alias("err_a"),
        (F.col("y_pred_b") - F.col("y_true_b")).alias("err_b"),
    )


def error_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """How alike two models fail, and what their mean gains over the better one."""
    both = join_oof(a, b)
    blend = (F.col("y_pred_a") + F.col("y_pred_b")) / 2
    overall = both.agg(
        F.count("*").alias("n_shared_rows"),
        F.round(correlation("err_a", "err_b"), 4).alias("global_error_corr"),
        rmse_of(F.col("y_true_a"), F.col("y_pred_a")).alias("_a"),
        rmse_of(F.col("y_true_b"), F.col("y_pred_b")).alias("_b"),
        rmse_of(F.col("y_true_a"), blend).alias("_m"),
    )
    per = both.groupBy("well_id").agg(correlation("err_a", "err_b").alias("c"), F.count("*").alias("n"))
    usable = F.when((F.col("n") >= 3) & ~F.isnan("c"), F.col("c"))
    used = per.withColumn("c", usable)
    mid = medians(used, [], ["c"]).select(F.round(F.coalesce("c", F.lit(0.0)), 4).alias("per_well_corr_median"))
    rest = used.agg(
        F.count("*").alias("n_shared_wells"),
        F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 4).alias("per_well_corr_mean"),
        F.round(F.coalesce(F.stddev_pop("c"), F.lit(0.0)), 4).alias("per_well_corr_std"),
    )
    out = overall.join(F.broadcast(mid), how="cross").join(F.broadcast(rest), how="cross")  # one row each
    return out.select(
        "n_shared_rows",
        "n_shared_wells",
        "global_error_corr",
        "per_well_corr_median",
        "per_well_corr_mean",
        "per_well_corr_std",
        F.round("_a", 4).alias("rmse_a"),
        F.round("_b", 4).alias("rmse_b"),
        F.round("_m", 4).alias("rmse_mean_blend"),
        F.round(F.col("_m") - F.least("_a", "_b"), 4).alias("blend_gain_vs_best"),
    )


def best_worst(oof: DataFrame, top_n: int = 10) -> DataFrame:
    """The ``top_n`` worst and best series by error; a series in both lists appears twice."""
    per = _series_errors(oof).select(
        "well_id", F.col("n").alias("n_rows"), F.round(F.sqrt(F.col("sse") / F.col("n")), 4).alias("rmse_delta")
    )
    worst = per.orderBy(F.desc("rmse_delta"), "well_id").limit(top_n).withColumn("side", F.lit("worst"))
    best = per.orderBy("rmse_delta", F.desc("well_id")).limit(top_n).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


def report(oof: DataFrame, series: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """All diagnostics as ``section, key, metric, value`` rows."""

    def long(df: DataFrame, section: str, key: Column, names: list[str]) -> DataFrame:
        cells = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.explode(F.array(*cells)).alias("c")).select(
            "section", "key", "c.metric", "c.value"
        )

    placed = with_position(oof, series)
    by_fold = rmse_by_fold(oof)
    folds = cv_summary(by_fold, "rmse_delta").select(
        F.round("rmse_mean", 4).alias("rmse_mean"), F.round("rmse_std", 4).alias("rmse_std")
    )
    per = _series_errors(oof)
    summary = per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_wells"), _pooled().alias("rmse_delta"))
    spread_ = dispersion(oof).withColumn("flattening", (F.col("std_ratio") < 0.7).cast("int"))
    parts = [
        long(summary, "summary", F.lit("all"), summary.columns),
        long(by_fold, "by_fold", F.col("fold"), ["n_rows", "n_wells", "rmse_delta", "rmse_full"]),
        long(folds, "folds", F.lit("all"), folds.columns),
        long(rmse_by_position(placed), "by_position", F.col("grp"), ["n_rows", "rmse_delta"]),
        long(rmse_by_length(placed), "by_length", F.col("bin"), ["n_wells", "n_rows", "rmse_delta"]),
        long(spread_, "dispersion", F.lit("all"), spread_.columns),
        long(best_worst(oof), "best_worst", F.concat_ws(":", "side", "well_id"), ["n_rows", "rmse_delta"]),
    ]
    if other is not None:
        pair = error_correlation(oof, other).withColumn("blend_helps", (F.col("blend_gain_vs_best") < 0).cast("int"))
        parts.append(long(pair, "error_correlation", F.lit("all"), pair.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
