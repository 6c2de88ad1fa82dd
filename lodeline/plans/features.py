"""The feature table: which families are on, and one plan for all of them."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.operators import align, formation, knn, refcurve, wavelet
from lodeline.operators import windows as W
from lodeline.operators.anchors import anchors, join_anchors
from lodeline.functions.blocks import spread
from lodeline.session import written_once

BASE = ["md", "x", "y", "z", "gr", "md_relative"]
POINT = ["x", "y", "z"]
MOST_NEAR = 50


@dataclass(frozen=True)
class Flags:
    """Feature families. Trajectory brings geometry with it; curve families need a reference table, the neighbour families
    (spatial, formation_plane) the known series."""

    tvt_input: bool = False
    geometry: bool = False
    gr: bool = False
    trajectory: bool = False
    typewell: bool = False
    gr_dwt: bool = False
    dtw: bool = False
    geology: bool = False
    beam: bool = False
    z_drift: bool = False
    summary_only: bool = False
    spatial: bool = False
    formation_plane: bool = False


def feature_table(
    df: DataFrame,
    flags: Flags,
    reference: DataFrame | None = None,
    residual_target: bool = True,
    keep: list[str] = (),
    size: int | None = None,
    known: DataFrame | None = None,
    series_id: Column | None = None,
) -> DataFrame:
    """``(well_id, row_idx)``, the ``keep`` columns, and the columns of every family that is on, in fixed order.

    All native families share one exchange on ``(well_id, block)``. Families computed by their own jobs (wavelet,
    alignment, neighbours) are joined on the row key. ``known`` are the series that neighbours come from, all of them:
    for training, :func:`fold_blocks` leaves out those of the fold that is predicted. ``series_id`` numbers a series. The anchor constant is a feature only when the target is not already
    relative to it.
    """
    families = [W.base()]
    if flags.geometry or flags.trajectory:
        families.append(W.geometry())
    if flags.trajectory:
        families.append(W.trajectory())
    if flags.gr:
        families += [W.rolling([W.ROLL_WINDOW]), W.cumulative_energy()]
    if flags.geology:
        families.append(W.formation_zscores())
    if flags.z_drift:
        families.append(W.z_drift())
    passed = ["md", "x", "y", "z", "gr"]
    rows = W.build(df, families, [*keep, *[c for c in passed if c not in keep]], size)
    key = ["well_id", "row_idx"]
    if flags.gr_dwt:
        rows = rows.join(wavelet.wavelet_features(df, size=size), key)
    if reference is not None:
        if flags.typewell:
            rows = rows.join(refcurve.residuals(df, reference, flags.summary_only, size), key, "left")
        if flags.dtw:
            rows = rows.join(align.dtw_features(df, reference), key, "left")
        if flags.beam:
            rows = rows.join(align.beam_features(df, reference), key, "left")
    if known is not None:
        if flags.spatial:
            points = knn.point_reference(known, F.shiftleft(series_id, 32) + F.col("row_idx"))
            found = knn.neighbours(points, df, POINT, MOST_NEAR, ["tvt_input"], finish=knn.spatial_features, batch=knn.spatial_batch())
            rows = rows.join(knn.attach(df, found.drop("label"), POINT), key)
        if flags.formation_plane:
            positions = formation.impute_formations(formation.formation_reference(known), formation.series_positions(df), series_id)
            rows = rows.join(formation.plane_features(df, positions, size), key)
    if flags.tvt_input and not residual_target:
        last = join_anchors(spread(df.select(*key), size=size), anchors(df), size)
        rows = rows.join(last.select(*key, F.col("last_known").alias("last_tvt_input")), key)
    return rows


def fold_blocks(
    df: DataFrame, fold_of: DataFrame, folds: list[int], flags: Flags, series_id: Column, size: int | None = None, asked: Column | None = None
) -> DataFrame:
    """The neighbour families of every row for each fold that may not be seen: ``well_id, row_idx, fold`` and the columns.

    ``fold_of`` is ``(well_id, n, fold)``. Neighbours come from all series outside the fold, for rows of the fold and for
    the rows that train its models alike; a row of another fold may be near to its own series. With ``asked``, only rows for
    which it is true get the columns, so that a caller pays for no others.
    """
    key = ["well_id", "row_idx", "fold"]
    every = F.explode(F.array(*map(F.lit, folds)))
    label = fold_of.select("well_id", "n", F.col("fold").cast("int").alias("label"))
    wanted = df if asked is None else df.filter(asked)
    out = wanted.select("well_id", "row_idx", every.alias("fold"))
    if flags.spatial:
        known = df.select("well_id", "row_idx", *POINT, "tvt_input")
        known = join_anchors(spread(known, size=size), label, size).drop("block", "n")
        points = knn.point_reference(known, F.shiftleft(series_id, 32) + F.col("row_idx"), F.col("label"))
        found = knn.neighbours_by_fold(points, wanted, POINT, MOST_NEAR, ["tvt_input"], folds, finish=knn.spatial_features, batch=knn.spatial_batch())
        names = [c for c in found.columns if c not in (*POINT, "fold")]
        rows = wanted.select("well_id", "row_idx", *POINT, every.alias("fold")).join(found, [*POINT, "fold"], "left")
        out = rows.select(*key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))
    if flags.formation_plane:
        depths = formation.formation_reference(df).join(label.drop("n"), "well_id")
        positions = formation.series_positions(df).withColumn("label", every)
        found = formation.impute_formations(depths, positions, series_id)
        plane = formation.plane_features(df, found, size, asked).withColumnRenamed("label", "fold")
        out = out.join(plane, key)
    return out


def feature_columns(table: DataFrame, keep: list[str] = ()) -> list[str]:
    drop = {"well_id", "row_idx", *keep} - set(BASE)
    return [c for c in table.columns if c not in drop]


def cached_feature_table(df: DataFrame, flags: Flags, source: str, reference: DataFrame | None = None, **kw) -> DataFrame:
    """The table written to the shared folder under a digest of its settings and inputs, and read from there afterwards,
    by other sessions as well.

    Inputs are told apart by ``source``, their columns and the paths, sizes and times of the files they are read from.
    Inputs that are read from no files are told apart within a session only.
    """
    tables = [t for t in (df, reference, kw.get("known")) if t is not None]
    plain = {k: str(v) for k, v in kw.items() if k != "known"}
    settings = sorted((asdict(flags) | plain).items())
    inputs = [(t.schema.json(), sorted(t.inputFiles())) for t in tables]
    digest = hashlib.sha256(repr((source, settings, inputs)).encode()).hexdigest()
    sources = tables if all(files for _, files in inputs) else None
    return written_once(df.sparkSession, f"features:{digest}", lambda: feature_table(df, flags, reference, **kw), sources)
