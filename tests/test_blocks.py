"""Results must not depend on how a series is cut into blocks."""

import pytest
from conftest import assert_same, collect, make_reference, make_series, reference_df, series_df
from pyspark.sql import functions as F

from lodeline.operators import baselines as B
from lodeline.operators import savgol, wavelet
from lodeline.operators import windows as W
from lodeline.operators import metrics, refcurve
from lodeline.plans import features


@pytest.fixture(scope="module")
def df(spark):
    return series_df(spark, make_series(n=90, cut=50, gaps=0.2)).persist()


FAMILIES = [W.base, W.geometry, W.rolling, W.lag_lead, W.cumulative_energy, W.envelope, W.z_drift, W.z_physics,
            W.trajectory, W.formation_zscores, W.sequence]


@pytest.mark.parametrize("make", FAMILIES, ids=lambda f: f.__name__)
def test_family(df, make):
    whole = collect(W.build(df, [make()]))
    for size in (7, 16):
        assert_same(collect(W.build(df, [make()], size=size)), whole)


def test_families_together_equal_families_alone(df):
    alone = collect(W.build(df, [W.cumulative_energy()], size=9))
    both = collect(W.build(df, [W.rolling([101]), W.cumulative_energy(), W.sequence()], size=9))
    assert_same(both[["well_id", "row_idx", "gr_energy"]], alone)


@pytest.mark.parametrize(
    "run",
    [
        lambda d, s: W.interpolate_gaps(d, radius=3, size=s),
        lambda d, s: W.target_derivative(d, s).drop("md", "tvt_input"),
        lambda d, s: W.series_zscore(d, ["md", "gr"], s),
        lambda d, s: B.baselines(d, ["slope_md", "slope_recent", "wls"], recent_window=20, size=s),
        lambda d, s: wavelet.wavelet_features(d, 32, 16, s),
        lambda d, s: savgol.smooth(d.select("well_id", "row_idx", "tvt"), "tvt", 11, 2, s),
        lambda d, s: savgol.smooth(d.filter("row_idx % 3 <> 1").select("well_id", "row_idx", "tvt"), "tvt", 7, 3, s),
        lambda d, s: savgol.postprocess(d.select("well_id", "row_idx", "tvt"), "tvt", 11, 2, 5005.0, 5050.0, "smooth_clip", s),
        lambda d, s: W.integrate_derivative(
            W.target_derivative(d, s).filter("tvt_input IS NULL").withColumn("o", F.lit(5.0)), "dtvt_dmd", "o", s
        ),
    ],
    ids=["gaps", "derivative", "zscore", "baselines", "wavelet", "savgol", "savgol_gappy", "postprocess", "integrate"],
)
def test_operator(df, run):
    whole = collect(run(df, None))
    for size in (8, 40):
        assert_same(collect(run(df, size)), whole, 1e-8)


def test_sliding_windows(df):
    a = W.sliding_windows(df, 8, 3, ["md", "gr"], "tvt").orderBy("well_id", "start").collect()
    b = W.sliding_windows(df, 8, 3, ["md", "gr"], "tvt", size=10).orderBy("well_id", "start").collect()
    assert a == b
    assert all(len(r["md"]) == 8 for r in a)
    assert [r["start"] for r in a if r["well_id"] == "w000"] == list(range(0, 90 - 8 + 1, 3))


def test_continuity(df):
    a = W.continuity(df, "tvt", 1.0, 5).orderBy("well_id").collect()
    b = W.continuity(df, "tvt", 1.0, 5, size=6).orderBy("well_id").collect()
    assert a == b


def test_grid_scores(spark, df):
    oof = df.filter("tvt_input IS NULL").select(
        "well_id", "row_idx", F.lit(0).alias("fold"), F.col("tvt").alias("y_true"), F.col("md").alias("y_pred"), F.lit(1.0).alias("baseline")
    )
    settings = savgol.grid([(1100.0, 1160.0)], windows=(5, 11, 31), polyorders=(2, 3))
    a = collect(savgol.grid_scores(oof, settings), "setting")
    b = collect(savgol.grid_scores(oof, settings, size=13), "setting")
    assert_same(a, b)
    # The scored chain is the one that is applied.
    smoothed = savgol.smooth(oof.select("well_id", "row_idx", (F.col("y_pred") + 1.0).alias("p")), "p", 11, 2)
    e = smoothed.join(oof, ["well_id", "row_idx"]).agg(F.sqrt(F.avg((F.col("p") - F.col("y_true") - 1.0) ** 2))).first()[0]
    i = settings.index(savgol.Setting(11, 2))
    assert abs(a["rmse"][i] - e) < 1e-9


def test_window_match_blocks(spark, df):
    curve = reference_df(spark, make_reference(m=150))
    rows = df.withColumn("anchor", F.col("tvt") + F.col("row_idx") % 5)
    a = collect(refcurve.window_match(rows, curve, window=6, band=40.0))
    for block in (9, 32):
        assert_same(collect(refcurve.window_match(rows, curve, window=6, band=40.0, block=block)), a)


def test_naive_validation_blocks(df):
    assert metrics.naive_validation(df).collect() == metrics.naive_validation(df, size=11).collect()


def test_feature_table_shuffles_rows_once(spark, df):
    """One exchange of the rows on (well_id, block); the other exchanges carry per-series or per-block tables."""
    path_free = features.feature_table(df.select("*"), features.Flags(geometry=True, gr=True))
    plan = path_free._jdf.queryExecution().executedPlan().toString()
    rows_exchanged = [l for l in plan.splitlines() if "Exchange hashpartitioning(well_id" in l and "block" in l]
    assert plan.count("Window [") <= 3
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert rows_exchanged


def test_partition_order_does_not_matter(spark, df):
    shuffled = df.repartition(7, "gr").sortWithinPartitions(F.desc("row_idx"))
    fam = [W.geometry(), W.cumulative_energy()]
    assert_same(collect(W.build(shuffled, fam)), collect(W.build(df, [W.geometry(), W.cumulative_energy()])))
