"""Edge cases of the series operators against plain numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from conftest import collect, make_reference, make_series, reference_df, series_df, to_spark
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeline.functions.scalars import clip, correlation, signed_log, signed_log_inverse
from lodeline.operators import anchors as A
from lodeline.operators import baselines as B
from lodeline.operators import blend, metrics, refcurve, savgol, wavelet
from lodeline.operators import windows as W

ALL = [W.base, W.geometry, W.rolling, W.lag_lead, W.cumulative_energy, W.envelope, W.z_drift, W.z_physics,
       W.trajectory, W.formation_zscores, W.sequence]


def one(n, known, gr=None):
    s = make_series(n=n, cut=0, wells=1, gaps=0)
    s["tvt_input"] = np.where(known, s.tvt, np.nan)
    if gr is not None:
        s["gr"] = gr
    return s


SHAPES = {
    "single_known": one(1, [True]),
    "single_unknown": one(1, [False]),
    "no_cut": one(6, [True] * 6),
    "nothing_known": one(6, [False] * 6),
    "no_signal": one(6, [True] * 3 + [False] * 3, np.nan),
    "tail_gap": one(6, [True] * 3 + [False] * 3, [50, np.nan, 52, 53, np.nan, np.nan]),
    "scattered": one(8, [True, True, False, True, False, False, True, False]),
}


@pytest.fixture(scope="module")
def shapes(spark):
    parts = [s.assign(well_id=name) for name, s in SHAPES.items()]
    return series_df(spark, pd.concat(parts, ignore_index=True)).persist()


def test_anchors(shapes):
    got = {r["well_id"]: r for r in A.anchors(shapes).collect()}
    assert [got[k]["ps"] for k in SHAPES] == [0, 0, 5, 0, 3, 3, 2]
    assert [got[k]["has_cut"] for k in SHAPES] == [False, True, False, True, True, True, True]
    assert got["nothing_known"]["last_known"] is None
    assert got["scattered"]["last_known"] == SHAPES["scattered"].tvt[6]
    with pytest.raises(Exception, match="without cut row"):
        A.strict_anchors(shapes).collect()


@pytest.mark.parametrize("make", ALL, ids=lambda f: f.__name__)
def test_families_on_odd_shapes(shapes, make):
    fam = make()
    out = collect(W.build(shapes, [fam], keep=["gr"]))
    assert len(out) == sum(len(s) for s in SHAPES.values())
    may_be_null = {"z_physics", "gr_envelope", "z_local_delta"}
    dense = [c for c in fam.outputs if c not in may_be_null and not c.startswith("gr_d")]
    assert not out[dense].isna().any().any()


def test_families_against_pandas(spark):
    s = make_series(n=130, cut=70, gaps=0.2)
    fams = [W.rolling(), W.envelope(), W.cumulative_energy(), W.lag_lead(), W.sequence(), W.geometry(), W.trajectory()]
    out = collect(W.build(series_df(spark, s), fams, size=50))
    for w, rows in s.groupby("well_id"):
        rows, got = rows.reset_index(drop=True), out[out.well_id == w].reset_index(drop=True)
        gr = rows.gr
        for k in W.ROLL_WINDOWS:
            roll = gr.rolling(k, center=True, min_periods=1)
            np.testing.assert_allclose(got[f"gr_roll_mean_{k}"], roll.mean().fillna(0), atol=1e-9)
            np.testing.assert_allclose(got[f"gr_roll_std_{k}"], roll.std().fillna(0), atol=1e-6)
        np.testing.assert_allclose(got.gr_lead_15, gr.shift(-15).fillna(0))
        np.testing.assert_allclose(got.gr_d2, gr.diff().diff().fillna(0))
        count = gr.notna().cumsum().replace(0, 1)
        np.testing.assert_allclose(got.gr_energy, (gr.fillna(0) ** 2).cumsum() / count)
        for c in W.SEQUENCE_COLUMNS:
            v = rows[c].ffill().bfill().fillna(0.0)
            prev = v.shift(1).bfill()
            np.testing.assert_allclose(got[f"{c}_diff2"], v.diff(2).fillna(0))
            np.testing.assert_allclose(got[f"{c}_lag5"], v.shift(5).fillna(0))
            np.testing.assert_allclose(got[f"{c}_roll_mean10"], prev.rolling(10, min_periods=1).mean().fillna(0))
            np.testing.assert_allclose(got[f"{c}_roll_std3"], prev.rolling(3, min_periods=1).std().fillna(0), atol=1e-6)
        cut, n = 70 + 4 * int(w[1:]), len(rows)
        frac = np.zeros(n)
        frac[cut:] = np.linspace(0, 1, n - cut)
        np.testing.assert_allclose(got.frac_after_ps, frac)
        np.testing.assert_allclose(got.z_local_delta, rows.z - rows.z[:cut].mean())


def test_trailing_features_ignore_the_future(spark):
    s = make_series(n=80, cut=50, wells=1)
    changed = s.copy()
    changed.loc[40:, ["x", "y", "z", "md"]] += 100.0
    changed.loc[40:, "gr"] = 99.0
    fams = [W.cumulative_energy, W.sequence, W.formation_zscores]
    a = collect(W.build(series_df(spark, s), [f() for f in fams]))[:40]
    b = collect(W.build(series_df(spark, changed), [f() for f in fams]))[:40]
    pd.testing.assert_frame_equal(a, b)
    wa, wb = (collect(wavelet.wavelet_features(series_df(spark, d), 32, 8))[:40] for d in (s, changed))
    pd.testing.assert_frame_equal(wa, wb)


def test_no_feature_reads_the_target(spark):
    s = make_series(n=60, cut=30)
    hidden = s.assign(tvt=-1.0)
    for make in ALL:
        a, b = (collect(W.build(series_df(spark, d), [make()])) for d in (s, hidden))
        pd.testing.assert_frame_equal(a, b)


def test_baselines_against_numpy(spark):
    s = make_series(n=400, cut=250, gaps=0)
    out = collect(B.baselines(series_df(spark, s), B.METHODS, size=64))
    for w, rows in s.groupby("well_id"):
        rows, got = rows.reset_index(drop=True), out[out.well_id == w].reset_index(drop=True)
        known = rows.tvt_input.notna()
        k, u = rows[known], rows[~known]
        last = k.iloc[-1]

        def line(x, cnt=None, weights=None):
            t = k if cnt is None else k.iloc[-cnt:]
            return last.tvt + np.polyfit(t[x], t.tvt, 1, w=weights)[0] * (u[x] - last[x])

        want = {"flat": np.full(len(u), last.tvt), "slope_md": line("md"), "slope_z": line("z"),
                "slope_recent": line("md", 200), "wls": line("md", 200, np.exp(0.02 * np.arange(200)))}
        assert got.loc[known, [f"baseline_{m}" for m in B.METHODS]].isna().all().all()
        for m, v in want.items():
            np.testing.assert_allclose(got.loc[~known, f"baseline_{m}"], v, rtol=1e-7, err_msg=m)


def test_baseline_edges(shapes):
    out = collect(B.baseline(shapes, "wls"))
    assert out[out.well_id == "nothing_known"].baseline.isna().all()
    assert out[out.well_id == "no_cut"].baseline.isna().all()
    with pytest.raises(ValueError):
        B.baseline(shapes, "cubic")


def test_derivative_and_its_integral(spark):
    s = make_series(n=30, cut=0, wells=1)
    s["md"] = 1000.0 + np.arange(30) * 2
    d = collect(W.target_derivative(series_df(spark, s)))
    assert d.dtvt_dmd.iloc[-1] == d.dtvt_dmd.iloc[-2]
    np.testing.assert_allclose(d.dtvt_dmd[:-1], np.diff(s.tvt) / 2)
    lone = collect(W.target_derivative(series_df(spark, one(1, [False]))))
    assert lone.dtvt_dmd.tolist() == [0.0]


def test_sliding_windows_and_padding(spark):
    s = make_series(n=10, cut=5, wells=1)
    df = series_df(spark, s)
    assert W.sliding_windows(df, 11, 1, ["gr"], "tvt").count() == 0
    r = W.sliding_windows(df, 4, 2, ["gr", "md"], "tvt").orderBy("start").collect()
    assert [x["start"] for x in r] == [0, 2, 4, 6] and r[1]["label"] == s.tvt[5]
    assert [None if np.isnan(v) else v for v in s.gr[2:6]] == r[1]["gr"]
    pred = df.select("well_id", "row_idx", F.when(F.col("row_idx") >= 3, F.col("md")).alias("pred"))
    padded = collect(W.pad_head(pred, 4))
    assert padded.pred[:4].tolist() == [s.md[3]] * 4 and padded.pred[9] == s.md[9]
    assert collect(W.pad_head(pred.withColumn("pred", F.lit(None).cast("double")), 40)).pred.tolist() == [0.0] * 10


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(1, 3), st.data())
def test_fit_matrix(half, order, data):
    window = 2 * half + 1
    v = np.array(data.draw(st.lists(st.floats(-1e3, 1e3), min_size=window, max_size=window)))
    t = np.arange(window)
    want = np.polyval(np.polyfit(t - half, v, min(order, window - 1)), t - half)
    np.testing.assert_allclose(savgol.fit_matrix(window, min(order, window - 1)) @ v, want, atol=1e-6)


def test_smooth_against_local_fits(spark):
    s = make_series(n=40, cut=0, wells=2)
    out = collect(savgol.smooth(series_df(spark, s).select("well_id", "row_idx", "tvt"), "tvt", 9, 2))
    for w, rows in s.groupby("well_id"):
        v, got = rows.tvt.to_numpy(), out[out.well_id == w].tvt.to_numpy()
        for i in range(len(v)):
            b = min(max(i - 4, 0), len(v) - 9)
            t = np.arange(9)
            assert got[i] == pytest.approx(np.polyval(np.polyfit(t, v[b : b + 9], 2), i - b), abs=1e-7)
    short = series_df(spark, make_series(n=9, cut=0, wells=1)).select("well_id", "row_idx", "tvt")
    assert collect(savgol.smooth(short, "tvt", 9, 2)).tvt.tolist() == make_series(n=9, cut=0, wells=1).tvt.tolist()
    with pytest.raises(ValueError):
        savgol.smooth(short, "tvt", 8, 2)


def test_grid_and_choice(spark):
    settings_ = savgol.grid([(0.0, 1.0), (5.0, 5.0)], windows=(3, 31), polyorders=(2, 3))
    assert settings_[0] == savgol.Setting() and settings_[1] == savgol.BASELINE
    assert len(settings_) == len(set(settings_)) == 1 + 3 + 1 + 3  # raw, smoothers, clip, both; the empty clip is out
    s = make_series(n=120, cut=0, wells=2)
    oof = series_df(spark, s).select("well_id", "row_idx", F.lit(0).alias("fold"), F.col("tvt").alias("y_true"), (F.col("tvt") + F.when(F.col("row_idx") % 2 == 0, 3).otherwise(-3)).alias("y_pred"), F.lit(0.0).alias("baseline"))
    found = {r["setting"]: r for r in savgol.grid_search(oof, settings_).collect()}
    assert [k for k, r in found.items() if r["chosen"]] == [min(found, key=lambda k: found[k]["rmse"])] or found[1]["chosen"]
    assert found[0]["delta_vs_raw"] == 0 and found[1]["delta_vs_default"] == 0
    kept = [r["setting"] for r in savgol.grid_search(oof, settings_, min_delta=1e9).collect() if r["chosen"]]
    assert kept == [1]


def plain_match(s, c, anchor, window, band):
    """Row by row, all windows of the band."""
    gr, cg, ct, n = s.gr.fillna(0).to_numpy(), c.gr.to_numpy(), c.tvt.to_numpy(), len(s)
    cut = int(np.flatnonzero(s.tvt_input.isna())[0]) if s.tvt_input.isna().any() else n - 1
    out = {}
    for i in range(cut, n):
        own = gr[max(0, i - window) : i + window + 1]
        inside = np.flatnonzero((ct >= anchor[i] - band) & (ct <= anchor[i] + band)) if np.isfinite(anchor[i]) else []
        if len(c) < 3 or len(own) < 3 or len(inside) < len(own):
            out[i] = anchor[i]
            continue
        band_gr = cg[inside]  # a window is made of the rows of the band alone
        sad = [np.abs(band_gr[b : b + len(own)] - own).sum() for b in range(len(inside) - len(own) + 1)]
        out[i] = ct[inside[int(np.argmin(sad)) + len(own) // 2]]
    return out


@pytest.mark.parametrize("block", [4096, 16])
@pytest.mark.parametrize("m, band, order", [(120, 30.0, "up"), (120, 5.0, "up"), (2, 30.0, "up"), (120, 30.0, "down"), (200, 30.0, "mixed"), (120, 0.0, "mixed")])
def test_window_match(spark, m, band, order, block):
    """Curves that rise, fall, and run up and down with equal and missing targets."""
    s, c = make_series(n=60, cut=35, gaps=0.2), make_reference(m=m)
    if order == "down":
        c["tvt"] = c.tvt.to_numpy()[::-1]
    elif order == "mixed":
        c["tvt"] = np.where(c.tw_idx % 17 == 3, np.nan, 4980.0 + np.random.default_rng(3).integers(0, 90, len(c)))
    anchor = s.tvt + np.where(s.row_idx % 11 == 0, np.nan, s.row_idx % 4)
    rows = to_spark(spark, s.assign(anchor=anchor, row_idx=s.row_idx.astype(int))[["well_id", "row_idx", "gr", "tvt_input", "anchor"]], "well_id string, row_idx int, gr double, tvt_input double, anchor double")
    out = collect(refcurve.window_match(rows, reference_df(spark, c), window=8, band=band, block=block))
    for w, part in s.groupby("well_id"):
        part = part.reset_index(drop=True)
        want = plain_match(part, c[c.well_id == w], anchor[s.well_id == w].to_numpy(), 8, band)
        got = out[out.well_id == w]
        assert got.row_idx.tolist() == list(want)
        np.testing.assert_allclose(got.matched_tvt, list(want.values()))


def test_interpolation_is_clamped(spark):
    c = reference_df(spark, make_reference(wells=1, m=20))
    points = spark.createDataFrame([("w000", 4000.0), ("w001", 1.0)], "well_id string, q double")
    r = make_reference(wells=1, m=20)
    out = refcurve.interpolate_at(c, points, {"low": F.col("q"), "mid": F.lit(4983.25), "high": F.lit(9e9), "none": F.lit(None).cast("double")}).collect()
    assert len(out) == 1 and out[0]["low"] == r.gr[0] and out[0]["high"] == r.gr[19] and out[0]["none"] is None
    assert out[0]["mid"] == pytest.approx(np.interp(4983.25, r.tvt, r.gr))


def test_residuals_without_anchor_are_zero(spark):
    s = make_series(n=10, cut=0, wells=1)
    out = collect(refcurve.residuals(series_df(spark, s), reference_df(spark, make_reference(wells=1))))
    assert (out.drop(columns=["well_id", "row_idx"]) == 0).all().all()


def test_blends(spark):
    nan = float("nan")
    rows = spark.createDataFrame(
        [("a", 0, 1.0, 2.0, 9.0), ("a", 1, 1.0, None, 9.0), ("a", 2, 1.0, nan, nan), ("a", 3, None, None, None)],
        "well_id string, row_idx int, model double, z_physics double, matched double",
    )
    assert [r["tvt"] for r in blend.blend(rows).orderBy("row_idx").collect()] == [2.0, 5.0, 1.0, None]
    got = [r["tvt"] for r in blend.blend(rows, (0.5, 0.25, 0.25)).orderBy("row_idx").collect()]
    assert got[:3] == pytest.approx([3.25, (0.5 + 2.25) / 0.75, 1.0])
    strict = [r["tvt"] for r in blend.blend(rows, (0.5, 0.25, 0.25), compat=True).orderBy("row_idx").collect()]
    assert strict[:3] == [3.25, 1.0, 1.0]
    zero = blend.blend(rows.filter("row_idx = 1"), (0.0, 1.0, 0.0)).first()["tvt"]
    assert zero == 5.0  # the only weight belongs to a missing value: the median decides


def test_rmse_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "a double, b double")
    assert metrics.rmse(df, "a", "b").first()["rmse"] == pytest.approx(np.sqrt(2.5))
    for bad in (df.filter("a > 9"), df.withColumn("b", F.lit(float("nan"))), df.withColumn("b", F.lit(None).cast("double"))):
        with pytest.raises(Exception, match="rmse of"):
            metrics.rmse(bad, "a", "b").collect()


def test_diagnostics(spark):
    s = make_series(n=40, cut=20, wells=4)
    df = series_df(spark, s)
    oof = df.filter("tvt_input IS NULL").select(
        "well_id", "row_idx", (F.substring("well_id", 4, 1).cast("int") % 2).alias("fold"), F.col("tvt").alias("y_true"),
        F.col("md").alias("y_pred"), F.lit(0.0).alias("baseline"),
    )
    p = collect(metrics.with_position(oof, df))
    for w, rows in p.groupby("well_id"):
        k = len(rows)
        np.testing.assert_allclose(rows.frac_after_ps, np.arange(k) / (k - 1))
        assert rows.rows_since_ps.tolist() == list(range(k)) and (rows.well_post_ps_length == k).all()
    placed = metrics.with_position(oof, df)
    by_pos = {r["grp"]: r for r in metrics.rmse_by_position(placed).collect()}
    cut = pd.cut(p.frac_after_ps, 10, labels=False, include_lowest=True)
    for b, rows in p.groupby(cut):
        assert by_pos[f"bin_{b:02d}"]["n_rows"] == len(rows)
        assert by_pos[f"bin_{b:02d}"]["rmse_delta"] == round(float(np.sqrt(((rows.y_true - rows.y_pred) ** 2).mean())), 4)
    assert by_pos["first_5"]["n_rows"] == 20
    lengths = p.groupby("well_id").well_post_ps_length.first()
    want = pd.qcut(lengths, 5, duplicates="drop", labels=False).value_counts().to_dict()
    assert {r["bin"]: r["n_wells"] for r in metrics.rmse_by_length(placed).collect()} == want
    same = metrics.error_correlation(oof, oof).first()
    assert same["global_error_corr"] == 1.0 and same["blend_gain_vs_best"] == 0.0
    flat = metrics.error_correlation(oof, oof.withColumn("y_pred", F.col("y_true"))).first()
    assert flat["global_error_corr"] is None and flat["per_well_corr_mean"] == 0.0
    assert metrics.dispersion(oof.withColumn("y_true", F.lit(1.0))).first()["std_ratio"] == 0.0
    both = metrics.best_worst(oof, 3).collect()
    assert len(both) == 6 and {r["side"] for r in both} == {"best", "worst"}
    assert metrics.with_position(oof, df.withColumn("tvt_input", F.col("tvt"))).filter(
        "frac_after_ps IS NULL AND rows_since_ps = -1 AND well_post_ps_length = 0"
    ).count() == len(p)


def test_scalars(spark):
    df = spark.createDataFrame([(-3.0,), (0.0,), (2.5,), (None,)], "v double")
    back = df.select("v", signed_log_inverse(signed_log(F.col("v"))).alias("b"), clip(F.col("v"), -1, 1).alias("c")).collect()
    assert [r["c"] for r in back] == [-1.0, 0.0, 1.0, None]
    assert all(r["v"] is None or abs(r["b"] - r["v"]) < 1e-9 for r in back)
    assert df.withColumn("k", F.lit(1.0)).agg(correlation("v", "k").alias("c")).first()["c"] is None
