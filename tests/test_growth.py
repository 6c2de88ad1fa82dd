"""Steps whose work or disk must grow no faster than the input."""

import datetime
import glob

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodeline.operators import folds, knn, refcurve
from lodeline.plans import features
from lodeline.sources import tables

from conftest import collect, make_series, to_spark

SERIES = "well_id string, row_idx int, split string, md double, x double, y double, z double, gr double, tvt double, tvt_input double"


def plain_windows(gr, first, length, anchor, cgr, ctvt, starts, band):
    """The closest window of each row, one start after another."""
    out = []
    for f, n, a in zip(first, length, anchor):
        inside = np.flatnonzero((ctvt >= a - band) & (ctvt <= a + band))
        best = (-1, np.inf, np.nan)
        for b in range(len(inside) - n + 1 if n >= 3 else 0):
            d = np.abs(cgr[inside[b : b + n]] - gr[f : f + n]).sum()
            if inside[b] < starts and d < best[1]:
                best = (inside[b], d, ctvt[inside[b + n // 2]])
        out.append(best)
    return [np.array(v) for v in zip(*out)]


@pytest.mark.parametrize("order", ["up", "down", "flat", "mixed"])
@pytest.mark.parametrize("whole", [True, False])
def test_best_windows_equal_plain_ones(order, whole, monkeypatch):
    """Ties, short windows at the ends, and values that are not whole numbers; the same to the last bit."""
    monkeypatch.setattr(refcurve, "STRETCH", 16)
    rng = np.random.default_rng(3)
    for _ in range(12):
        m, n = int(rng.integers(5, 90)), int(rng.integers(20, 70))
        ctvt = {"flat": np.full(m, 9.0), "mixed": rng.integers(0, 60, m) * 3.0}.get(order, np.sort(rng.normal(size=m) * 50 + 60))
        ctvt = ctvt[::-1].copy() if order == "down" else ctvt
        gr, cgr = (rng.integers(0, 4, k).astype(float) if whole else rng.normal(size=k) for k in (n, m))
        row = np.sort(rng.choice(n, n // 2, replace=False))
        first = np.maximum(row - 6, 0)
        given = gr, first, np.minimum(row + 7, n) - first, rng.normal(size=len(row)) * 40 + 80, cgr, ctvt, int(rng.integers(0, m + 1)), 60.0
        for got, want in zip(refcurve.best_windows(*given, cells=50), plain_windows(*given)):
            np.testing.assert_array_equal(got, want)


def test_rows_of_a_rising_curve_are_compared_in_stretches(monkeypatch):
    """Anchors that all differ see different curve rows; they do not cost a step each."""
    calls, whole = [], refcurve._stretch_windows
    monkeypatch.setattr(refcurve, "_stretch_windows", lambda *a: calls.append(1) or whole(*a))
    rng, row = np.random.default_rng(1), np.arange(25, 575)
    refcurve.best_windows(rng.normal(size=600), row - 25, np.full(550, 51), 300 + row * 0.8, rng.normal(size=300), np.arange(300) * 4.0, 300, 200.0)
    assert 0 < len(calls) <= 550 // refcurve.STRETCH + 2


def test_totals_of_a_series_are_by_month(spark, tmp_path):
    """Rows are numbered and summed in shipping order whatever the split, and a split is not as small as a day or a week."""
    rng = np.random.default_rng(5)
    n = 900
    lines = pd.DataFrame(
        {
            "l_orderkey": np.arange(n), "l_partkey": rng.integers(0, 50, n), "l_suppkey": rng.integers(0, 3, n), "l_linenumber": rng.integers(1, 8, n).astype("int32"),
            "l_quantity": rng.integers(1, 51, n).astype(float), "l_extendedprice": rng.random(n) * 900, "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100,
            "l_shipdate": [datetime.datetime(1995, 1, 1) + datetime.timedelta(days=int(d)) for d in rng.integers(0, 300, n)],
        }
    )
    spark.createDataFrame(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = tables._derive_series(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "date_trunc(month" in plan
    got = made.orderBy("well_id", "row_idx").toPandas()
    lines = lines.sort_values(["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])
    by = lines.groupby("l_suppkey")
    np.testing.assert_array_equal(got.row_idx, by.cumcount())
    np.testing.assert_array_equal(got.md, 1000 + by.l_quantity.cumsum())
    dx = (lines.l_discount * 100).round() - 5
    np.testing.assert_array_equal(got.x, lines.l_suppkey * 10 + dx.groupby(lines.l_suppkey).cumsum())


def points(spark, count=400):
    at = np.random.default_rng(2).integers(0, 9, (count, 3)).astype(float)
    rows = [(int(i), *map(float, p), float(i % 17), int(i % 3)) for i, p in enumerate(at)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, tvt_input double, label int")


def test_lists_of_neighbours_are_written_only_for_queries_that_look_further(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(knn, "stage", lambda df, kept=[]: kept.append(1) or _written(df, f"{tmp_path}/{len(kept):02d}"))
    ref = points(spark)
    asked = ref.select("x", "y", "z", "label")
    found = knn.neighbours(ref, asked, ["x", "y", "z"], 10, ["tvt_input"], cell_points=50, finish=lambda d: knn.spatial_features(d, [5]))
    assert "near" not in found.columns
    got = {tuple(r[:4]): tuple(r[4:]) for r in found.collect()}
    first = [pq.read_table(f) for f in sorted(glob.glob(f"{tmp_path}/*/*.parquet")) if "todo" in pq.read_schema(f).names]
    lists = [(r["_near"] is None, not r["todo"]) for t in first for r in t.select(["_near", "todo"]).to_pylist()]
    assert any(done for _, done in lists) and all(none == done for none, done in lists)
    near = knn.neighbours(ref, asked, ["x", "y", "z"], 10, ["tvt_input"], cell_points=10_000)
    want = {tuple(r[:4]): tuple(r[4:]) for r in knn.spatial_features(near, [5]).collect()}
    assert got == want


def _written(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_fold_blocks_of_asked_rows(spark):
    """Asked rows get the columns that they have among all rows, and no others are searched."""
    s = make_series(n=40, cut=20, wells=5)
    for i, f in enumerate(tables.FORMATIONS):
        s[f] = -9050.0 - 30 * i + s.x / 64
    df = to_spark(spark, s, SERIES + "".join(f", {f} double" for f in tables.FORMATIONS))
    fold_of = folds.group_folds(folds.series_sizes(df), 2)
    number = F.expr("substring(well_id, 2)").cast("bigint")
    flags = features.Flags(spatial=True, formation_plane=True)
    every = collect(features.fold_blocks(df, fold_of, [0, 1], flags, number))
    asked = collect(features.fold_blocks(df, fold_of, [0, 1], flags, number, asked=F.col("tvt_input").isNull()))
    unknown = s[s.tvt_input.isna()][["well_id", "row_idx"]]
    want = every.merge(unknown, on=["well_id", "row_idx"]).sort_values(["well_id", "row_idx", "fold"]).reset_index(drop=True)
    got = asked.sort_values(["well_id", "row_idx", "fold"]).reset_index(drop=True)
    assert len(got) == 2 * len(unknown)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
