import threading

import numpy as np
import pytest
from conftest import make_series, series_df
from pyspark.sql import functions as F

from lodeline.operators import anchors as A
from lodeline.operators import savgol
from lodeline.plans import features, predict, training

FLAGS = features.Flags(geometry=True, gr=True)
SMALL = training.Params(trees=3, depth=2, min_rows=1)


@pytest.fixture(scope="module")
def table(spark):
    df = series_df(spark, make_series(n=30, cut=15, wells=6))
    t = features.feature_table(df, FLAGS, keep=["tvt", "tvt_input"])
    columns = features.feature_columns(t, ["tvt", "tvt_input"])
    rows = t.filter("tvt_input IS NULL").join(A.last_known(df), "well_id").withColumns(
        {
            "baseline": F.col("last_known"),
            "target": F.col("tvt") - F.col("last_known"),
            "fold": F.substring("well_id", 4, 1).cast("int") % 3,
        }
    )
    return rows.persist(), columns


def test_feature_set(table):
    assert len(table[1]) == 18 and not {"tvt", "tvt_input", "well_id", "row_idx"} & set(table[1])


def test_out_of_fold(table):
    rows, columns = table
    oof = training.out_of_fold(rows, columns, [1, 2], SMALL)
    assert oof.count() == rows.count() == oof.select("well_id", "row_idx").distinct().count()
    assert oof.columns == ["well_id", "row_idx", "fold", "y_true", "y_pred", "baseline", "trees"]
    with pytest.raises(ValueError):
        training.out_of_fold(rows.withColumn("fold", F.col("row_idx") % 2), columns, [1], SMALL)


def test_rows_of_a_fold_do_not_train_its_models(table):
    rows, columns = table
    poisoned = rows.withColumn("target", F.when(F.col("fold") == 0, 1e9).otherwise(F.col("target")))
    a, b = (training.out_of_fold(t, columns, [1], SMALL).filter("fold = 0") for t in (rows, poisoned))
    pa, pb = (t.orderBy("well_id", "row_idx").toPandas().y_pred for t in (a, b))
    np.testing.assert_allclose(pa, pb)


def test_best_prefix():
    errors = [5.0, 4.0, 3.0, 3.5, 3.2, 2.0, 2.0, 2.1, 2.2, 1.0]
    assert training.best_prefix(errors, 2) == (3, True)
    assert training.best_prefix(errors, 3) == (6, True)
    assert training.best_prefix(errors, 4) == (10, False)
    assert training.best_prefix([1.0], 1) == (1, False)


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_patience_cuts_behind_the_best_tree(table, loss):
    rows, columns = table
    params = training.Params(trees=24, depth=2, min_rows=1, learning_rate=0.5, patience=3, loss=loss)
    held = rows.filter("fold = 0")
    fitted = training.fit_seeds(rows.filter("fold <> 0"), columns, [3], params, held)
    whole = training.Params(trees=24, depth=2, min_rows=1, learning_rate=0.5, loss=loss).estimator(3).fit(training.assemble(rows.filter("fold <> 0"), columns))
    errors = whole.evaluateEachIteration(training.assemble(held, columns), loss)
    best, _ = training.best_prefix(errors, 3)
    assert fitted.models[0].getNumTrees == best < 24
    np.testing.assert_allclose(fitted.errors[0], errors[: len(fitted.errors[0])])
    cut = fitted.predict(held).toPandas()
    e = (cut.y_pred - cut.target).abs()
    assert ((e**2).mean() if loss == "squared" else e.mean()) == pytest.approx(errors[best - 1])
    assert (e**2).mean() if loss == "squared" else e.mean() == pytest.approx(errors[best - 1])
    if loss == "squared":
        assert (e**2).mean() == pytest.approx(errors[best - 1])


def test_final_model_with_patience(table, tmp_path, spark):
    rows, columns = table
    params = training.Params(trees=16, depth=2, min_rows=1, learning_rate=0.5, patience=2)
    model = training.fit_final(rows, columns, [3, 4], params, holdout=0.5)
    assert all(m.getNumTrees <= 16 for m in model.models) and len(model.errors) == 2
    training.save_model(spark, model, str(tmp_path / "m"))
    loaded, _ = training.load_model(spark, str(tmp_path / "m"))
    a, b = (m.predict(rows).orderBy("well_id", "row_idx").toPandas().y_pred for m in (model, loaded))
    np.testing.assert_allclose(a, b)


def test_features_by_fold_reach_their_fold_only(table):
    rows, columns = table
    keys = rows.select("well_id", "row_idx", F.col("fold").alias("own"), "target").crossJoin(rows.select(F.col("fold").alias("fold")).distinct())
    # a feature that gives the target away, but only to the models of one fold
    by_fold = keys.select("well_id", "row_idx", "fold", F.when(F.col("fold") == 1, F.col("target")).otherwise(0.0).alias("hint"))
    params = training.Params(trees=12, depth=3, min_rows=1, learning_rate=0.5)
    oof = training.out_of_fold(rows, columns, [1], params, by_fold=by_fold).toPandas()
    assert len(oof) == rows.count()
    plain = training.out_of_fold(rows, columns, [1], params).toPandas()
    both = oof.merge(plain, on=["well_id", "row_idx", "fold", "y_true"])
    other, seen = both[both.fold != 1], both[both.fold == 1]
    np.testing.assert_allclose(other.y_pred_x, other.y_pred_y)
    assert ((seen.y_true - seen.y_pred_x) ** 2).mean() < 0.7 * ((seen.y_true - seen.y_pred_y) ** 2).mean()


def test_saved_model_scores_the_same(spark, table, tmp_path):
    rows, columns = table
    ensemble = training.fit_seeds(rows, columns, [1, 2], SMALL)
    training.save_model(spark, ensemble, str(tmp_path / "m"), postproc={"savgol_window": 31}, feature_flags={"gr": True})
    loaded, contract = training.load_model(spark, str(tmp_path / "m"))
    assert contract["feature_columns"] == columns and contract["postproc"] == {"savgol_window": "31"}
    a = training.score(rows, ensemble, contract).orderBy("well_id", "row_idx").toPandas()
    b = training.score(rows.select(*reversed(rows.columns)), loaded, contract).orderBy("well_id", "row_idx").toPandas()
    np.testing.assert_allclose(a.tvt, b.tvt)
    members = ensemble.predict(rows, keep_members=True).select("y_pred", "y_pred_s0", "y_pred_s1").toPandas()
    np.testing.assert_allclose(members.y_pred, members[["y_pred_s0", "y_pred_s1"]].mean(axis=1))
    with pytest.raises(ValueError, match="missing columns"):
        training.score(rows.drop(columns[0]), loaded, contract)


def test_prediction_plan(spark, table):
    rows, columns = table
    ensemble = training.fit_seeds(rows, columns, [1], SMALL)
    contract = {"residual_target": True, "postproc": {"savgol_window": "5", "savgol_polyorder": "2", "clip_lower": "None"}}
    ids = rows.filter("row_idx >= 20").select(F.concat_ws("_", "well_id", "row_idx").alias("id"), (F.col("row_idx") * 10).alias("pos"))
    raw = training.score(rows, ensemble, contract).filter("row_idx >= 20")
    key = lambda df: {r["id"]: r["tvt"] for r in df.collect()}
    named = lambda df: key(df.select(F.concat_ws("_", "well_id", "row_idx").alias("id"), "tvt"))
    run = lambda **kw: predict.predict_pipeline(ids, rows, ensemble, contract, **kw)
    stored = run()
    assert stored.columns == ["id", "pos", "tvt"]
    assert key(stored) == pytest.approx(named(savgol.smooth(raw, "tvt", 5, 2))) and key(stored) != pytest.approx(named(raw))
    assert key(run(off=True)) == pytest.approx(named(raw))
    mid = float(np.median(list(named(raw).values())))
    clipped = key(run(wanted=predict.Postprocessing(clip_lower=mid - 1, clip_upper=mid + 1, apply_order="smooth_clip")))
    assert clipped == pytest.approx({k: min(max(v, mid - 1), mid + 1) for k, v in named(raw).items()})
    with pytest.raises(Exception, match="."):
        predict.predict_pipeline(ids.union(spark.createDataFrame([("w000_9999", 1)], ids.schema)), rows, ensemble, contract).collect()


@pytest.mark.parametrize("bad", [{"savgol_window": "4"}, {"clip_lower": "1"}, {"clip_lower": "2", "clip_upper": "1"}, {"apply_order": "both"}, {"other": "1"}])
def test_stored_postprocessing_is_checked(bad):
    with pytest.raises(ValueError):
        predict.Postprocessing.stored({"postproc": bad})


def test_search_is_sorted(table):
    rows, columns = table
    out = training.param_search(rows, columns, SMALL, trials=2).collect()
    assert [r["rmse_mean"] for r in out] == sorted(r["rmse_mean"] for r in out) and len(out) == 2


def test_registered_search_does_its_whole_job(spark, monkeypatch):
    from lodeline import catalog

    asked = []
    monkeypatch.setattr(catalog, "training_table", lambda spark, sf: ("table", ["x"]))
    monkeypatch.setattr(training, "param_search", lambda table, columns, base, trials=10, **kw: asked.append((table, base, trials, kw)))
    catalog.queries()["param_search"](spark, "nowhere")
    [(table, base, trials, others)] = asked
    assert table == "table" and trials == 100 and not others
    assert base == training.Params(patience=50) and base.most_trees == 3000 and base.trees is None


@pytest.fixture
def fits(monkeypatch):
    """How many fits ran at a time, most at the end."""
    running, most, lock, fit = [0], [0], threading.Lock(), training._fit

    def counted(*args):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return fit(*args)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(training, "_fit", counted)
    return most


def test_fits_that_do_not_fit_in_memory_wait(table, fits, monkeypatch):
    rows, columns = table
    wide = training.out_of_fold(rows, columns, [1, 2], SMALL).agg(F.count("*"), F.sum("y_pred")).first()
    monkeypatch.setattr(training, "storage_memory", lambda spark: 1)
    fits[0] = 0
    assert training.out_of_fold(rows, columns, [1, 2], SMALL).agg(F.count("*"), F.sum("y_pred")).first() == pytest.approx(wide)
    assert fits[0] == 1
    training.param_search(rows, columns, SMALL, trials=2)
    assert fits[0] == 1


def test_fits_at_once(spark, monkeypatch):
    assert training.storage_memory(spark) > 1 << 20
    a_row = training.ROW_BYTES + 10 * training.BIN_BYTES
    monkeypatch.setattr(training, "storage_memory", lambda spark: 3500 * a_row)
    assert [training.fits_at_once(spark, n, 10, 8) for n in (0, 100, 1000, 3500, 10**9)] == [8, 8, 3, 1, 1]


def test_search_writes_its_vectors_once(table, monkeypatch):
    rows, columns = table
    written, stage = [], training.stage
    monkeypatch.setattr(training, "stage", lambda df, **kw: written.append(df.columns) or stage(df, **kw))
    training.param_search(rows, columns, SMALL, trials=3)
    assert len([c for c in written if "features" in c]) == 1


def test_fold_scaler(table):
    rows, _ = table
    scaler = training.fold_scaler(rows.withColumn("k", F.lit(4.0)), ["md", "k"])
    got = {r["fold"]: r for r in scaler.collect()}
    pdf = rows.select("fold", "md").toPandas()
    for f, r in got.items():
        other = pdf[pdf.fold != f].md
        assert r["md_mean"] == pytest.approx(other.mean()) and r["md_scale"] == pytest.approx(other.std(ddof=0))
        assert r["k_scale"] is None
    scaled = training.scale(rows.select("fold", "md"), scaler, ["md"])
    back = training.unscale(scaled, scaler, "md", "md").toPandas()
    np.testing.assert_allclose(sorted(back.md), sorted(pdf.md))


def test_feature_cache(spark, table):
    df = series_df(spark, make_series(n=20, cut=10, wells=2))
    a = features.cached_feature_table(df, FLAGS, "here")
    assert a.inputFiles() == features.cached_feature_table(df, FLAGS, "here").inputFiles()
    assert a.inputFiles() != features.cached_feature_table(df, features.Flags(), "here").inputFiles()
    wider = df.withColumn("more", df.gr)
    assert a.inputFiles() != features.cached_feature_table(wider, FLAGS, "here").inputFiles()


def test_all_families_at_once(spark):
    from conftest import make_reference, reference_df

    df = series_df(spark, make_series(n=40, cut=20, wells=2))
    flags = features.Flags(**{f: True for f in features.Flags.__dataclass_fields__ if f != "summary_only"})
    t = features.feature_table(df, flags, reference_df(spark, make_reference(wells=2)), residual_target=False)
    cols = features.feature_columns(t)
    assert t.count() == df.count() and len(cols) == len(set(cols))
    assert {"last_tvt_input", "dtw_optimal_tvt", "beam_std", "tw_gr_std", "gr_dwt_approx", "tortuosity_window_50"} <= set(cols)
    assert "last_tvt_input" not in features.feature_table(df, features.Flags(tvt_input=True)).columns
