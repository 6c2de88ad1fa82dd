"""The registered queries: each takes a session and a table folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions.blocks import KEYS, per_block, spread
from lodeline.functions.scalars import clip, round_of_many, signed_log, signed_log_inverse
from lodeline.operators import align, blend, contracts, folds, formation, knn, metrics, refcurve, savgol, wavelet
from lodeline.operators import anchors as A
from lodeline.operators import baselines as B
from lodeline.operators import windows as W
from lodeline.plans import features, predict, training
from lodeline.session import folder_once, shared_dir, stage, written_once
from lodeline.sources import files
from lodeline.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
#: From so many columns on, their rounding outgrows what the JVM compiles as one method.
MANY = 16


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Round every double, so that results of different summation orders compare equal."""
    names = [c for c, t in df.dtypes if t == "double" and c not in exact]
    of = F.round if len(names) < MANY else round_of_many
    return df.select(*[of(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def family(*makers: Callable[[], W.Family], keep: list[str] = ()) -> Query:
    return lambda spark, sf: rounded(W.build(S.series(spark, sf), [make() for make in makers], keep))


def on_series(fn: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf: rounded(fn(S.series(spark, sf)), digits)


def train(spark: SparkSession, sf: str) -> DataFrame:
    return S.series(spark, sf).filter("split = 'train'")


def _residual_target(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("tvt") - F.col("baseline")
    return A.train_rows(train(spark, sf)).select(
        "well_id", "row_idx", y.alias("y"), "baseline", (F.col("baseline") + y).alias("back")
    )


def _integrate(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    slopes = spread(W.target_derivative(df).filter("tvt_input IS NULL"))
    started = A.join_anchors(slopes, A.anchors(df).select("well_id", "n", "last_known")).drop("block", "n")
    return rounded(W.integrate_derivative(started, "dtvt_dmd", "last_known"), digits=5)


def _pad_head(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    return W.pad_head(df.select("well_id", "row_idx", F.when(F.col("row_idx") >= 31, F.col("tvt")).alias("pred")), 32)


def pair(fn: Callable[[DataFrame, DataFrame], DataFrame], digits: int = 6) -> Query:
    """A query over the series and their reference curves."""
    return lambda spark, sf: rounded(fn(S.series(spark, sf), S.reference(spark, sf)), digits)


def on_oof(fn: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf: rounded(fn(S.oof(spark, sf)), digits)


def second_model(oof: DataFrame) -> DataFrame:
    return oof.withColumn("y_pred", F.col("y_pred_b"))


def number(well: str = "well_id"):
    """The supplier number inside a series name."""
    return S.series_number(well)


def physics_anchor(df: DataFrame) -> DataFrame:
    """Series rows with the z-physics estimate as ``anchor``, the centre of the window search."""
    return W.build(df, [W.z_physics()], keep=["gr", "tvt_input"]).withColumnRenamed("z_physics", "anchor")


def model_rows(df: DataFrame) -> DataFrame:
    """A stand-in model for the unknown rows: the target continues along the position."""
    rows = A.with_anchors(df, "md_cut").filter("tvt_input IS NULL")
    return rows.select(
        "well_id", "row_idx", (F.col("last_known") + (F.col("md") - F.col("md_cut")) / 32).alias("model")
    )


def _strategies(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    return blend.strategies(df, S.reference(spark, sf), model_rows(df))


def _blend_grid(spark: SparkSession, sf: str) -> DataFrame:
    df = train(spark, sf)
    rows = blend.strategies(df, S.reference(spark, sf), model_rows(df))
    truth = df.select("well_id", "row_idx", F.col("tvt").alias("truth"))
    return rounded(blend.compare_strategies(stage(rows), truth))


def _knn3d(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    ref = knn.point_reference(df.filter("split = 'train'"), F.shiftleft(number(), 32) + F.col("row_idx"))
    found = knn.neighbours(ref, df, ["x", "y", "z"], 50, ["tvt_input"], finish=knn.spatial_features, batch=knn.spatial_batch())
    return rounded(knn.attach(df, found.drop("label"), ["x", "y", "z"]))


def _knn_oof(spark: SparkSession, sf: str) -> DataFrame:
    df = train(spark, sf).withColumn("label", (number() % 5).cast("int"))
    ref = knn.point_reference(df, F.shiftleft(number(), 32) + F.col("row_idx"), F.col("label"))
    found = knn.neighbours(ref, df, ["x", "y", "z"], 50, ["tvt_input"], finish=knn.spatial_features, batch=knn.spatial_batch())
    return rounded(knn.attach(df, found, ["x", "y", "z"]))


def _knn_folds(spark: SparkSession, sf: str) -> DataFrame:
    df = train(spark, sf)
    fold_of = A.anchors(df).select("well_id", "n", (number() % 5).cast("int").alias("fold"))
    return rounded(features.fold_blocks(df, fold_of, list(range(5)), features.Flags(spatial=True), number()))


def _impute(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    ref = formation.formation_reference(df.filter("split = 'train'"))
    return formation.impute_formations(ref, formation.series_positions(df), number())


def _formation_plane(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(formation.plane_features(S.series(spark, sf), _impute(spark, sf)))


def _fold_features(spark: SparkSession, sf: str) -> DataFrame:
    df = train(spark, sf)
    ref = formation.formation_reference(df).withColumn("label", (number() % 5).cast("int"))
    every = formation.series_positions(df).withColumn("label", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    found = formation.impute_formations(ref, every, number())
    return rounded(found.withColumnRenamed("label", "fold"))


def feature_flags() -> features.Flags:
    return features.Flags(geometry=True, gr=True)


def training_table(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """The 18-column table of the unknown train rows with residual target, baseline and one of ``FOLDS`` folds."""
    df = train(spark, sf)
    flags = feature_flags()
    table = features.cached_feature_table(df, flags, f"train:{sf}", keep=["tvt", "tvt_input"])
    columns = features.feature_columns(table, ["tvt", "tvt_input"])
    per = A.anchors(df).select("well_id", "n", "last_known").join(fold_of(df).drop("n"), "well_id")
    rows = A.join_anchors(spread(table.filter("tvt_input IS NULL AND tvt IS NOT NULL")), per)
    return rows.withColumns(
        {"baseline": F.col("last_known"), "target": F.col("tvt") - F.col("last_known")}
    ).select("well_id", "row_idx", "fold", "target", "baseline", *columns), columns


def fold_of(df: DataFrame) -> DataFrame:
    return folds.group_folds(folds.series_sizes(df), FOLDS)


FOLDS, SEEDS = 5, [42, 7, 123]
#: What the registered queries train: fewer and larger steps than the defaults of ``Params``, which take hours here.
MODEL = training.Params(trees=24, learning_rate=0.2, patience=6)
#: The search does its whole job: up to 3,000 trees, fewer only where 50 in a row gain nothing, and so many drawn settings.
SEARCH, TRIALS = training.Params(patience=50), 100


def _gbt_oof(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        table, columns = training_table(spark, sf)
        return training.out_of_fold(table, columns, SEEDS, MODEL)

    return written_once(spark, f"gbt_oof:{sf}", build)


def _gbt_skill(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the out-of-fold table, and whether the models of their fold are better there than the flat baseline."""
    oof = _gbt_oof(spark, sf)
    rmse = lambda e: F.sqrt(F.avg(e * e))
    per = oof.groupBy("fold").agg(
        (rmse(F.col("y_true") - F.col("y_pred")) < rmse(F.col("y_true"))).alias("better"),
        F.max(F.col("trees") <= MODEL.most_trees).alias("within"),
    )  # one row per fold
    return rounded(oof.join(F.broadcast(per), "fold").select("well_id", "row_idx", "fold", "y_true", "baseline", "better", "within"))


def _gbt_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Training with the neighbour families, found anew for each fold that is predicted."""
    table, columns = training_table(spark, sf)
    df = train(spark, sf)
    flags = features.Flags(spatial=True, formation_plane=True)
    # The rows of the table alone; neighbours are looked for among all known ones.
    unknown = F.expr("tvt_input IS NULL AND tvt IS NOT NULL")
    by_fold = features.fold_blocks(df, fold_of(df), list(range(FOLDS)), flags, number(), asked=unknown)
    oof = training.out_of_fold(table, columns, SEEDS[:1], MODEL, by_fold=by_fold)
    return metrics.with_position(oof.drop("trees"), S.series(spark, sf))


def _oof_table(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.with_position(_gbt_oof(spark, sf), S.series(spark, sf))


def _param_search(spark: SparkSession, sf: str) -> DataFrame:
    table, columns = training_table(spark, sf)
    return training.param_search(table, columns, SEARCH, trials=TRIALS)


POSTPROC = {"savgol_window": 31, "savgol_polyorder": 2, "clip_lower": 5050.0, "clip_upper": 5350.0, "apply_order": "smooth_clip"}


def _saved_model(spark: SparkSession, sf: str) -> tuple[training.Ensemble, dict]:
    """The final model, trained and saved once for a session, as another session would load it."""
    path = f"{shared_dir(spark)}/lodeline/{spark.sparkContext.applicationId}/model-{sf.strip('/').replace('/', '-')}"
    if path not in _models:
        table, columns = training_table(spark, sf)
        ensemble = training.fit_final(table, columns, SEEDS, MODEL)
        training.save_model(spark, ensemble, path, postproc=POSTPROC, cv_rmse_mean=None)
        _models.add(path)
    return training.load_model(spark, path)


_models: set[str] = set()


def _model_contract(spark: SparkSession, sf: str) -> DataFrame:
    return training.score(training_table(spark, sf)[0], *_saved_model(spark, sf))


def _predict_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Every id of the sample in its order, predicted by the saved model and clipped last to the bounds saved with it."""
    df = S.series(spark, sf).filter("split = 'test'")
    table = features.feature_table(df, feature_flags(), keep=["tvt_input"])
    rows = A.join_anchors(spread(table), A.anchors(df).select("well_id", "n", "last_known"))
    sample = with_file_order(ids(spark, sf))
    out = predict.predict_pipeline(sample, rows.withColumnRenamed("last_known", "baseline"), *_saved_model(spark, sf))
    inside = F.col("tvt").between(POSTPROC["clip_lower"], POSTPROC["clip_upper"])
    return out.select("pos", "id", inside.alias("inside"))


def _group_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return folds.group_holdout(S.series(spark, sf), 0.1, 42)


def _oof_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lodeline/{spark.sparkContext.applicationId}/oof"
    files.save_oof(S.oof(spark, sf), path, "z_drift")
    return files.load_oof(spark, path, "z_drift")


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    of = df.select("well_id", "split").distinct()
    curves = S.reference(spark, sf).groupBy("well_id").agg(F.count("*").alias("rows"))
    facts = (
        df.groupBy("split", "well_id")
        .agg(F.count("*").alias("rows"))
        .select("split", "well_id", F.lit("horizontal_well").alias("kind"), "rows")
        .unionByName(curves.join(of, "well_id").select("split", "well_id", F.lit("typewell").alias("kind"), "rows"))
    )
    return files.inventory(facts)


def on_files(fn: Callable[[SparkSession, str], DataFrame]) -> Query:
    """A query that reads the series and curves from CSV files."""
    return lambda spark, sf: fn(spark, S.csv_folder(spark, sf))


def _read_sample(spark: SparkSession, sf: str) -> DataFrame:
    asked = with_file_order(ids(spark, sf)).withColumn("tvt", F.lit("0.0"))
    path = folder_once(spark, f"sample:{sf}", lambda p: files.write_submission(asked, f"{p}/sample_submission.csv"))
    return files.read_sample(spark, path)


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return predict.submission_ids(S.series(spark, sf))


def with_file_order(df: DataFrame) -> DataFrame:
    """Ids with their line number, as a reader of the sample file would deliver them: series after series.

    Lines before a series are counted within 4096 series and over such groups, so no task orders all series.
    """
    placed = savgol.with_position(contracts.parse_id(df).select("id", "well_id", "row_idx")).drop("n")
    sizes = placed.groupBy("well_id").agg(F.count("*").alias("k"), (F.max("row_idx") + 1).alias("n"))
    sizes = sizes.withColumn("chunk", F.floor(number() / 4096))
    ahead = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sizes.groupBy("chunk").agg(F.sum("k").alias("k"))  # a row per 4096 series
    chunks = chunks.select("chunk", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("chunk").orderBy(number()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("s0", F.coalesce(F.sum("k").over(inside), F.lit(0))).join(chunks, "chunk")
    starts = per_block(starts.select("well_id", "n", (F.col("c0") + F.col("s0")).alias("before"))).select(*KEYS, "before")
    return spread(placed).join(starts, KEYS).select("id", (F.col("before") + F.col("pos")).alias("pos"))


def _id_violations(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    asked = df.select(
        F.when(F.col("row_idx") % 7 == 0, F.concat("well_id", F.lit("_x"))).otherwise(contracts.make_id("well_id", "row_idx")).alias("id")
    ).unionByName(df.groupBy("well_id").agg(F.max("row_idx").alias("m")).select(
        F.concat_ws("_", "well_id", (F.col("m") + 1).cast("string")).alias("id")
    ))
    return contracts.id_violations(asked, df)


def _nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    v = (
        F.when(F.col("gr").isNull(), F.lit(None))
        .when(F.col("gr") == 30, F.lit(float("nan")))
        .when(F.col("gr") == 149, F.lit(float("inf")))
        .otherwise(F.col("gr"))
    )
    return contracts.nonfinite_report(S.series(spark, sf).select(v.cast("double").alias("v")), "v")


def _predict_join(spark: SparkSession, sf: str) -> DataFrame:
    return predict.lookup(with_file_order(ids(spark, sf)), model_rows(S.series(spark, sf)), "model")


def _validate_output(spark: SparkSession, sf: str) -> DataFrame:
    expected = with_file_order(ids(spark, sf))
    made = predict.naive_predict(expected, S.series(spark, sf))
    # Damage the copy: some ids changed, some values not numbers or infinite, some lines lost, one column too many.
    k = F.col("pos") % 50
    actual = made.select(
        "pos",
        F.when(k == 3, F.concat("id", F.lit("0"))).otherwise(F.col("id")).alias("id"),
        F.when(k == 5, F.lit("n/a")).when(k == 7, F.lit("Infinity")).otherwise(F.col("tvt").cast("string")).alias("tvt"),
        F.lit("").alias("note"),
    ).filter(k != 11)
    return contracts.validate_output(expected, actual)


def _naive_predict(spark: SparkSession, sf: str) -> DataFrame:
    return predict.naive_predict(ids(spark, sf), S.series(spark, sf))


def _cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.cv_summary(training.fold_rmse(S.oof(spark, sf))))


def _fold_scaler(spark: SparkSession, sf: str) -> DataFrame:
    df = train(spark, sf).withColumn("fold", (number() % 5).cast("int"))
    cols = ["x", "y", "z", "md", "tvt"]
    scaler = training.fold_scaler(df, cols)
    scaled = training.scale(df.select("well_id", "row_idx", "fold", *cols), scaler, cols)
    back = training.unscale(scaled.withColumn("tvt_back", F.col("tvt")), scaler, "tvt_back", "tvt")
    return rounded(back)


def _seed_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    oof = S.oof(spark, sf)
    members = [F.col("y_pred"), F.col("y_pred_b"), (F.col("y_pred") + F.col("y_pred_b")) / 4]
    return rounded(oof.select("well_id", "row_idx", training.mean_of(members).alias("y_mean")))


def _set_ops(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    complete = df.filter("ancc IS NOT NULL").select("well_id")
    return contracts.set_differences(complete, df.filter("split = 'train'").select("well_id"))


def _fold_overlap(spark: SparkSession, sf: str) -> DataFrame:
    # A split by position instead of by series: every series leaks.
    df = S.series(spark, sf).select("well_id", (F.col("row_idx") % 3).alias("fold"))
    return folds.overlap(df)


def _signed_log(spark: SparkSession, sf: str) -> DataFrame:
    t = signed_log(F.col("y_true"))
    return rounded(
        S.oof(spark, sf).select("well_id", "row_idx", t.alias("y_log"), signed_log_inverse(t).alias("y_back"))
    )


def _clip(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    bounds = savgol.clip_bounds(df.filter("split = 'train'"))
    return rounded(
        savgol.clip_to(df.select("well_id", "row_idx", "tvt"), bounds, "p1.0-p99.0").withColumn(
            "fixed", clip(F.col("tvt"), 5100.0, 5400.0)
        )
    )


def full_oof(oof: DataFrame) -> DataFrame:
    return oof.select("well_id", "row_idx", (F.col("y_pred") + F.col("baseline")).alias("tvt"))


GRID_BOUNDS = [(5100.0, 5300.0), (5050.0, 5400.0)]


def _postproc_grid(oof: DataFrame) -> DataFrame:
    settings = savgol.grid(GRID_BOUNDS, windows=(5, 11, 31), polyorders=(2,))
    return savgol.grid_search(oof, settings)


def _full_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search with bounds from the train targets, as training runs it, and its best settings."""
    bounds = savgol.clip_bounds(train(spark, sf)).collect()  # three rows
    settings = savgol.grid([(b["lower"], b["upper"]) for b in sorted(bounds, key=lambda b: b["label"])])
    return rounded(savgol.top_settings(savgol.grid_search(S.oof(spark, sf), settings)), 4)


def _union_splits(spark: SparkSession, sf: str) -> DataFrame:
    df = S.series(spark, sf)
    test = df.filter("split = 'test'").select("well_id", "row_idx", "split", "md", "gr")
    return df.filter("split = 'train'").select("well_id", "row_idx", "split", "md", "gr", "tvt").unionByName(
        test, allowMissingColumns=True
    )


def _feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.feature_table(S.series(spark, sf), feature_flags()))


def queries() -> dict[str, Query]:
    return {
        # scans and anchors
        "scan_series": S.series,
        "scan_reference": S.reference,
        "series_ids": lambda spark, sf: S.series(spark, sf).select("split", "well_id").distinct(),
        "post_cut_rows": on_series(lambda d: A.post_cut_rows(d).select("well_id", "row_idx", "md", "gr")),
        "last_known": on_series(A.last_known),
        "cut_index": on_series(A.cut_index),
        "train_rows": lambda spark, sf: A.train_rows(train(spark, sf)),
        "residual_target": _residual_target,
        # baselines
        "baseline_flat": on_series(lambda d: B.baseline(d, "flat")),
        "baseline_slopes": on_series(lambda d: B.baselines(d, ["slope_md", "slope_z", "slope_recent"]), 4),
        "baseline_wls": on_series(lambda d: B.baseline(d, "wls"), 4),
        # windows
        "base_features": family(W.base, keep=["md", "x", "y", "z", "gr"]),
        "geometry": family(W.geometry),
        "rolling_signal": family(W.rolling),
        "lag_lead": family(W.lag_lead),
        "cum_energy": family(W.cumulative_energy),
        "envelope": family(W.envelope),
        "z_drift": family(W.z_drift),
        "z_physics": family(W.z_physics),
        "trajectory": family(W.trajectory),
        "zscores": family(W.formation_zscores),
        "sequence_features": family(W.sequence),
        "interpolate_gaps": on_series(lambda d: W.interpolate_gaps(d, radius=2)),
        "target_derivative": on_series(
            lambda d: W.target_derivative(d).filter("tvt_input IS NULL").select("well_id", "row_idx", "dtvt_dmd")
        ),
        "integrate_derivative": _integrate,
        "sliding_windows": on_series(lambda d: W.sliding_windows(d, 32, 16, ["md", "gr"], "tvt")),
        "pad_head": _pad_head,
        "series_zscore": on_series(lambda d: W.series_zscore(d, ["md", "x", "y", "z", "gr"])),
        "continuity": on_series(lambda d: W.continuity(d, "tvt", limit=1.5)),
        # scans, sinks and contracts
        "inventory": _inventory,
        "read_series": on_files(files.read_series),
        "read_reference": on_files(files.read_reference),
        "read_sample": _read_sample,
        "read_ids": on_files(files.list_series),
        "read_inventory": on_files(lambda spark, d: files.inventory(files.file_facts(spark, d))),
        "read_problems": on_files(files.problems),
        "oof_roundtrip": _oof_roundtrip,
        "parse_id": lambda spark, sf: contracts.parse_id(ids(spark, sf)),
        "nonfinite_report": _nonfinite,
        "id_violations": _id_violations,
        "predict_join": _predict_join,
        "naive_predict": _naive_predict,
        "validate_output": _validate_output,
        "model_contract": _model_contract,
        "predict_pipeline": _predict_pipeline,
        # reference curves
        "interp_asof": pair(refcurve.interp_asof),
        "nearest_asof": pair(refcurve.nearest_asof),
        "band_join": pair(refcurve.band_join),
        "reference_summary": lambda spark, sf: rounded(refcurve.summary(S.reference(spark, sf))),
        "reference_residuals": pair(refcurve.residuals),
        "formation_signal": lambda spark, sf: rounded(refcurve.formation_signal(S.reference(spark, sf))),
        "window_match": pair(lambda d, c: refcurve.window_match(physics_anchor(d), c)),
        # neighbours
        "knn3d": _knn3d,
        "knn_oof_exclusion": _knn_oof,
        "knn_fold_features": _knn_folds,
        "formation_reference": lambda spark, sf: formation.formation_reference(train(spark, sf)),
        "knn2d_impute": lambda spark, sf: rounded(_impute(spark, sf)),
        "formation_plane": _formation_plane,
        "fold_features": _fold_features,
        # alignment
        "wavelet": on_series(wavelet.wavelet_features, 5),
        "dtw_align": pair(align.dtw_features),
        "beam_align": pair(align.beam_align),
        "beam_features": pair(align.beam_features),
        # blends
        "blend_median": lambda spark, sf: rounded(blend.blend(_strategies(spark, sf))),
        "blend_weighted": lambda spark, sf: rounded(blend.blend(_strategies(spark, sf), (0.8, 0.1, 0.1))),
        "blend_grid": _blend_grid,
        # smoothing
        "savgol": on_oof(lambda o: savgol.smooth(full_oof(o)), 4),
        "clip": _clip,
        "clip_bounds": lambda spark, sf: rounded(savgol.clip_bounds(train(spark, sf))),
        "postprocess": on_oof(lambda o: savgol.postprocess(full_oof(o), "tvt", 31, 2, 5100.0, 5400.0), 4),
        "postproc_grid": on_oof(_postproc_grid, 4),
        "top_configs": _full_grid,
        "signed_log": _signed_log,
        # metrics
        "rmse": on_oof(lambda o: metrics.rmse(o, "y_true", "y_pred")),
        "naive_validation": lambda spark, sf: rounded(metrics.naive_validation(train(spark, sf))),
        "fallback_median": lambda spark, sf: rounded(metrics.fallback_median(train(spark, sf))),
        "range_report": lambda spark, sf: rounded(metrics.range_report(train(spark, sf)), 5),
        "oof_metadata": lambda spark, sf: rounded(metrics.with_position(S.oof(spark, sf), S.series(spark, sf))),
        "rmse_by_fold": on_oof(metrics.rmse_by_fold),
        "rmse_by_position": lambda spark, sf: metrics.rmse_by_position(
            metrics.with_position(S.oof(spark, sf), S.series(spark, sf))
        ),
        "rmse_by_length": lambda spark, sf: metrics.rmse_by_length(
            metrics.with_position(S.oof(spark, sf), S.series(spark, sf))
        ),
        "dispersion": on_oof(metrics.dispersion),
        "flattening_wells": on_oof(metrics.flattening_wells),
        "oof_join": on_oof(lambda o: metrics.join_oof(o, second_model(o))),
        "error_correlation": on_oof(lambda o: metrics.error_correlation(o, second_model(o))),
        "best_worst": on_oof(metrics.best_worst),
        "oof_report": lambda spark, sf: metrics.report(
            S.oof(spark, sf), S.series(spark, sf), second_model(S.oof(spark, sf))
        ),
        "cv_summary": _cv_summary,
        # folds and training
        "group_folds": lambda spark, sf: folds.group_folds(folds.series_sizes(train(spark, sf))),
        "fold_overlap": _fold_overlap,
        "strat_labels": lambda spark, sf: folds.stratification_labels(train(spark, sf)),
        "cluster_check": lambda spark, sf: folds.cluster_check(train(spark, sf)),
        "strat_labels_spatial": lambda spark, sf: folds.stratification_labels(train(spark, sf), clusters=5),
        "strat_folds": lambda spark, sf: folds.snake_folds(folds.stratification_labels(train(spark, sf))),
        "group_holdout": _group_holdout,
        "fold_scaler": _fold_scaler,
        "seed_ensemble": _seed_ensemble,
        "gbt_oof": _gbt_oof,
        "gbt_skill": _gbt_skill,
        "gbt_neighbours": _gbt_neighbours,
        "oof_table": _oof_table,
        "param_search": _param_search,
        # tables
        "feature_table": _feature_table,
        "set_ops": _set_ops,
        "union_splits": _union_splits,
    }
