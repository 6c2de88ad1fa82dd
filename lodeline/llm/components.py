"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import discard, keep


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours (only its smaller or its larger ones) hang from the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    around = both.where("v < u") if small else both
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if small:
        joined = around.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = joined.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``: the least node that links reach.

    Alternates stars over larger and over smaller neighbours until nothing changes; each round is written to the
    shared folder and the one before is removed. Links whose ends are equal or null are left out.
    """
    spark = edges.sparkSession
    now, path = keep(edges.where("a <> b").distinct(), "links")
    before = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = sign
        following, its_path = keep(_star(_star(now, False), True), "links")
        discard(spark, path)
        now, path = following, its_path
