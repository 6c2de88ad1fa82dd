import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodeline.session import session  # noqa: E402

SERIES = (
    "well_id string, row_idx int, split string, md double, x double, y double, z double, gr double, tvt double, "
    "tvt_input double"
)


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores=8, memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def make_series(n=60, cut=36, wells=3, seed=0, gaps=0.1, integers=True):
    """Series of different lengths with gaps in the signal and an unknown tail."""
    rng = np.random.default_rng(seed)
    parts = []
    for w in range(wells):
        k = n + 7 * w
        gr = rng.integers(30, 60, k).astype(float) if integers else rng.normal(80, 20, k)
        gr[rng.random(k) < gaps] = np.nan
        tvt = 5000 + np.cumsum(rng.integers(0, 8, k)) / 4
        known = np.arange(k) < cut + 4 * w
        parts.append(
            pd.DataFrame(
                {
                    "well_id": f"w{w:03d}",
                    "row_idx": np.arange(k),
                    "split": "train" if w % 3 else "test",
                    "md": 1000 + np.cumsum(rng.integers(0, 4, k)).astype(float),
                    "x": w * 10 + np.cumsum(rng.integers(-2, 3, k)).astype(float),
                    "y": w * 5 + np.cumsum(rng.integers(-2, 3, k)).astype(float),
                    "z": -9000 - np.cumsum(rng.integers(0, 8, k)) / 8,
                    "gr": gr,
                    "tvt": tvt,
                    "tvt_input": np.where(known, tvt, np.nan),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def make_reference(wells=3, m=80, seed=1, integers=True):
    rng = np.random.default_rng(seed)
    parts = []
    for w in range(wells):
        gr = rng.integers(30, 60, m).astype(float) if integers else rng.normal(80, 20, m)
        parts.append(
            pd.DataFrame({"well_id": f"w{w:03d}", "tw_idx": np.arange(m), "tvt": 4980.0 + np.arange(m), "gr": gr})
        )
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf, schema):
    rows = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame(list(rows.itertuples(index=False, name=None)), schema)


def series_df(spark, pdf):
    ints = pdf.assign(row_idx=pdf["row_idx"].astype(int))
    return to_spark(spark, ints, SERIES)


def reference_df(spark, pdf):
    return to_spark(spark, pdf, "well_id string, tw_idx int, tvt double, gr double")


def collect(df, *keys):
    return df.toPandas().sort_values(list(keys) or ["well_id", "row_idx"]).reset_index(drop=True)


def assert_same(a, b, tol=1e-9):
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=tol, atol=tol, err_msg=c)
        else:
            assert a[c].tolist() == b[c].tolist(), c
