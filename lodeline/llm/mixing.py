"""Operator 4: mixing sources to target weights, with DataFrame functions only.

Words are summed per source; a source's target over its size is its rate. Each document is taken ``floor(rate)`` times,
and once more with the rate's fraction as probability, drawn from a hash of its id and text. A few whole draws are made
side by side and each source uses the one whose words come nearest its target, so that a handful of long documents
does not decide how near it gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.common import WORD, keep, unused

DRAWS = 64
_RANGE = 1 << 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, one row per source.

    Sources in code point order, null last, get ``weights`` in turn. They share all words by weight; none gets over
    ``most`` times its size, and what it leaves is shared by weight among the others until none is above. With sources
    ordered by size over weight, those that stop come first, so running sums find where the sharing ends.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight)
    total = F.sum("source_size").over(Window.partitionBy())
    by_rate = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "left": total - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "open": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # a source stops if its even share of what is left would be above its limit
    rows = rows.withColumn("stops", F.col("weight") * F.col("left") > F.lit(most) * F.col("source_size") * F.col("open"))
    # the first that does not stop sets the level for all that follow: least "open" counts from the end
    first = F.max(F.when(~F.col("stops"), F.struct("open", "left")))
    rows = rows.withColumn("level", first.over(Window.partitionBy()))
    share = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.open")
    limit = (F.lit(most) * F.col("source_size")).cast("double")
    return rows.select("source", "source_size", F.coalesce(F.least(share, limit), limit).alias("target"))


def _draw(k: int | Column) -> Column:
    """The k-th draw of a row, below 2**32: a walk from one half of its hash in steps of the other."""
    return F.pmod(F.col("h1") + F.col("h2") * k, F.lit(_RANGE))


def plan_mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3
) -> DataFrame:
    """``(doc_id, row, size, source_size, target, copies)`` for every row of ``docs``.

    ``size`` is the number of words of the whole text, 0 for a null or empty one; null is a source of its own. Rows that
    repeat an id draw on their own texts, and equal rows draw alike. Sources without words have target 0 and no
    document is taken from them. ``row`` is a hash of the text that tells rows of one id apart.
    """
    digest = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "row"))
    half = lambda at: F.conv(F.substring("digest", at, 8), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("row"),
                       F.col(source).cast("string").alias("source"), size.alias("size"))
    rows = rows.withColumn("digest", digest)
    rows = rows.select("doc_id", "row", "source", "size", half(1).alias("h1"), half(9).alias("h2"))
    rows, _ = keep(rows, "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = targets.withColumns({"whole": F.floor("rate"), "part": F.floor((F.col("rate") - F.floor("rate")) * _RANGE)})
    targets, _ = keep(targets, "targets")
    same = lambda other: rows.join(other.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")))

    drawn = same(targets).groupBy("source").agg(
        *(F.sum(F.when(_draw(k) < F.col("part"), F.col("size")).otherwise(0)).alias(f"drawn{k}") for k in range(DRAWS))
    )
    wanted = F.col("target") - F.col("whole") * F.col("source_size")
    off = F.array_sort(F.array(*(F.struct(F.abs(F.col(f"drawn{k}") - wanted).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS))))
    nearest = drawn.join(targets.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")))
    nearest = nearest.select("source", "source_size", "target", "whole", "part", F.element_at(off, 1)["k"].alias("draw"))
    copies = F.col("whole") + (_draw(F.col("draw")) < F.col("part")).cast("long")
    return same(nearest).select("doc_id", "row", "size", "source_size", "target", F.when(F.col("target") > 0, copies).otherwise(0).alias("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`plan_mix` takes it, with all columns as they are."""
    names = {"id": "doc_id", "text": "text"} | {k: v for k, v in options.items() if k in ("id", "text")}
    own, row, copies, copy = (unused(docs, c) for c in ("mix_id", "mix_row", "mix_copies", "mix_copy"))
    plan = plan_mix(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias(own), F.col("row").alias(row), F.col("copies").cast("int").alias(copies)
    ).distinct()
    on = docs[names["id"]].cast("long").eqNullSafe(plan[own]) & (F.md5(F.coalesce(docs[names["text"]], F.lit(""))) == plan[row])
    out = docs.join(plan, on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*(docs[c] for c in docs.columns))
