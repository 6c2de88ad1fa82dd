"""Rounding of many columns."""

import numpy as np
from pyspark.sql import functions as F

from lodeline import catalog
from lodeline.functions import scalars


def test_rounds_as_round_does(spark):
    rng = np.random.default_rng(5)
    ties = (np.arange(-4000, 4000) + 0.5) / 1e6
    odd = [0.0, -0.0, -1e-9, float("inf"), -float("inf"), 1e300, 123456789.12345675, -0.0078125, 5e-324, 9000.0015625, 3.6e7 + 1 / 640]
    values = [*odd, *ties, *(rng.normal(size=4000) * 10.0 ** rng.integers(-8, 14, 4000)), *(rng.integers(-(10**9), 10**9, 4000) / 640)]
    df = spark.createDataFrame([(None,), (float("nan"),), *[(float(v),) for v in values]], "v double")
    text = lambda c: c.cast("string")
    for digits in (4, 6):
        differs = ~text(F.round("v", digits)).eqNullSafe(text(scalars.round_of_many("v", digits)))
        assert df.filter(differs).collect() == []


def test_rounding_of_many_columns_is_not_one_method(spark):
    """A stage of so many rounded columns would be a single method, which the JVM interprets."""
    wide = spark.range(3).select(*[(F.col("id") / (i + 2)).alias(f"c{i}") for i in range(62)])
    plan = catalog.rounded(wide)._jdf.queryExecution().executedPlan().toString()
    assert plan.startswith("Project"), plan[:80]  # a stage in one method begins with *(1)
    assert catalog.rounded(wide.select("c0"))._jdf.queryExecution().executedPlan().toString().startswith("*(1)")
