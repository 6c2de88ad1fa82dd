"""Names and numbers of series beyond six digits, and checks that depend on them."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodeline import catalog
from lodeline.operators import contracts, folds
from lodeline.sources import tables


def test_long_keys_keep_their_digits(spark):
    keys = [7, 999_999, 100_000, 1_000_000, 1_000_001, 12_345_678_901_234]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", tables.series_name(F.col("k")).alias("w"))
    names = {r.k: r.w for r in df.collect()}
    assert len(set(names.values())) == len(keys) and names[7] == "w000007" and names[1_000_000] == "w1000000"
    assert all(r.k == r.n for r in df.select("k", tables.series_number("w").alias("n")).collect())


def test_lines_of_long_series_do_not_overlap(spark):
    one = spark.range(1_000_100).select(F.concat(F.lit("w000001_"), F.col("id")).alias("id"))
    both = one.union(spark.createDataFrame([("w000002_5",), ("w9000000_3",), ("w9000000_4",)], "id string"))
    placed = catalog.with_file_order(both)
    end = placed.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
    assert tuple(end) == (1_000_103, 0, 1_000_102)
    rows = {r.id: r.pos for r in placed.where("not startswith(id, 'w000001_')").collect()}
    assert rows == {"w000002_5": 1_000_100, "w9000000_3": 1_000_101, "w9000000_4": 1_000_102}


def test_row_number_that_does_not_fit(spark):
    df = spark.createDataFrame([("w1_99999999999",)], "id string")
    assert contracts.parse_id(df, strict=False).first().row_idx is None
    with pytest.raises(PySparkException):
        contracts.parse_id(df).collect()


def test_columns_in_order(spark):
    expected = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, id string")
    swapped = spark.createDataFrame([(0, "1", "a"), (1, "2", "b"), (2, "3", "c")], "pos long, tvt string, id string")
    got = {r["check"]: r["violations"] for r in contracts.validate_output(expected, swapped).collect()}
    assert got["columns"] == 2 and got["row_count"] == 1
    right = contracts.validate_output(expected, swapped.select("pos", "id", "tvt").where("pos < 2"))
    assert all(r["violations"] == 0 for r in right.collect())


@pytest.mark.parametrize(("fraction", "held"), [(1.0, 30), (0.1, 3), (0.01, 1), (0.0, 0)])
def test_holdout_has_its_exact_share(spark, fraction, held):
    df = spark.createDataFrame([(f"w{i}",) for i in range(30)], "well_id string")
    assert folds.group_holdout(df, fraction).where("holdout").count() == held
