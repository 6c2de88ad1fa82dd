"""Operator 6: nested URL rules as a sort-merge range join on reversed hosts.

A host's key is its labels in reverse, each followed by a dot: ``blog.example.net`` is ``net.example.blog.``. A rule for
a host covers all keys that begin with its own, an interval of the sorted keys, and such intervals nest. Distinct hosts
and rules are sorted together by range; a sweep over each range keeps the stack of rules whose interval holds the
current key. A rule that opens before a range and reaches into it is given to that range as well, at most one row for
each range that it covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import discard, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    rest = F.substring_index(_rest(url), "/", 1)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.locate("/", rest)
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(part, key, host, rules)`` in order; rules of a key come before hosts of that key."""
    stack: list[tuple[str, list]] = []
    part = None
    for batch in batches:
        hosts, found = [], []
        for at, key, host, rules in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rules is not None:
                stack.append((key, rules))
            elif stack:
                hosts.append(host)
                found.append([r for _, own in reversed(stack) for r in own])
        if hosts:
            kind = pa.list_(pa.struct([("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(found, kind)], names=["host", "rules"])


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, rules)`` for each distinct host that a rule covers; the most specific host's rules come first, and
    of those the longest path."""
    spark = hosts.sparkSession
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host <> ''")
    # a rule given twice counts once; of two verdicts for one rule, block stands
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = F.struct("path", F.concat("host", "path").alias("rule"), "verdict")
    order = lambda a, b: F.when(F.length(a["path"]) > F.length(b["path"]), -1).when(F.length(a["path"]) < F.length(b["path"]), 1).otherwise(0)
    nests = rules.withColumn("own", own).groupBy("host").agg(F.array_sort(F.collect_list("own"), order).alias("rules"))
    nests = nests.select(key_of(F.col("host")).alias("key"), "rules")

    sorted_, path = keep(
        hosts.select("host").distinct().select(key_of(F.col("host")).alias("key"), "host")
        .repartitionByRange("key").withColumn("part", F.spark_partition_id()), "hosts"
    )
    ranges = sorted_.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))  # a row per range
    reach = nests.join(F.broadcast(ranges), (F.col("key") <= F.col("last")) & (F.concat("key", F.lit("\U0010ffff")) >= F.col("first")))
    kind = nests.schema["rules"].dataType
    both = sorted_.select("part", "key", "host", F.lit(None).cast(kind).alias("rules")).union(
        reach.select("part", "key", F.lit(None).cast("string").alias("host"), "rules")
    )
    swept = both.repartition("part").sortWithinPartitions("part", "key", F.col("rules").isNull())
    out, _ = keep(swept.mapInArrow(_sweep, "host string, rules array<struct<path:string,rule:string,verdict:string>>"), "swept")
    discard(spark, path)
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules(host, path, verdict)``: a rule fits its host and all its subdomains where the url's path starts with the
    rule's; of those that fit, the one with the longest host wins, then the longest path. Without one ``rule`` is null and
    the verdict is ``default``. A null url, or one without ``://``, has an empty host and path, which no rule fits.
    Repeated rows stay; an empty table gives none, and without rules everything gets the default.
    """
    rows = pages.select(F.col(id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    found = active_rules(rows.where("host <> ''"), rules)
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    joined = rows.join(found, "host", "left").withColumn("fit", F.try_element_at(fits, F.lit(1)))
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
