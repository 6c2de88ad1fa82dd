import numpy as np
import pytest

from lodeline.functions.quantiles import medians, quantiles

PROBS = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["normal", "few", "constant", "skewed"])
def test_large_groups_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    v = {
        "normal": rng.normal(0, 1, 3000),
        "few": rng.integers(0, 5, 3000).astype(float),
        "constant": np.full(3000, 7.5),
        "skewed": np.exp(rng.normal(0, 8, 3000)),
    }[kind]
    df = spark.createDataFrame([(int(i % 3 == 0), float(x), float(-x)) for i, x in enumerate(v)], "g int, a double, b double")
    out = {r["g"]: r for r in quantiles(df, ["g"], ["a", "b"], PROBS, limit=1500).collect()}
    for g in (0, 1):  # group 0 is above the limit, group 1 below
        part = np.array([x for i, x in enumerate(v) if int(i % 3 == 0) == g])
        np.testing.assert_allclose(out[g]["a"], np.quantile(part, PROBS), rtol=1e-12)
        np.testing.assert_allclose(out[g]["b"], np.quantile(-part, PROBS), rtol=1e-12)
    whole = quantiles(df, [], ["a"], PROBS, limit=10).first()["a"]
    np.testing.assert_allclose(whole, np.quantile(v, PROBS), rtol=1e-12)


def test_nulls_are_left_out(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0), (2, None)], "g int, a double")
    for limit in (0, 100):
        out = {r["g"]: r["a"] for r in medians(df, ["g"], ["a"], limit).collect()}
        assert out[1] == 2.0 and out.get(2) is None
