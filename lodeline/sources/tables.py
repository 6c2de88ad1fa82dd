"""Series, reference curves and out-of-fold predictions derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.session import folder_once, written_once
from lodeline.sources import files

FORMATIONS = ["ancc", "astnu", "astnl", "egfdu", "egfdl", "buda"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered series per supplier, in shipping order; written once for the same line items."""
    return written_once(spark, f"series:{sf_dir}", lambda: _derive_series(spark, sf_dir), [table(spark, sf_dir, "lineitem")])


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference curve per supplier: a row for each part it ships; written once for the same tables."""
    inputs = [table(spark, sf_dir, name) for name in ("lineitem", "part")]
    return written_once(spark, f"reference:{sf_dir}", lambda: _derive_reference(spark, sf_dir), inputs)


def _derive_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sk"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("ep"),
        (F.round(F.col("l_discount") * 100).cast("bigint") - 5).alias("dx"),
        (F.round(F.col("l_tax") * 100).cast("bigint") - 4).alias("dy"),
        # The month is the leading part of the sort key, so a supplier's rows split by month keep their order
        # and no task holds all rows of a supplier. Weeks would leave nearly as many totals as there are rows.
        F.date_trunc("month", "l_shipdate").alias("month"),
        F.date_trunc("week", "l_shipdate").alias("week"),
        "l_shipdate",
        "l_orderkey",
        "l_partkey",
    )
    inside = Window.partitionBy("sk", "month").orderBy("l_shipdate", "l_orderkey", "ln", "l_partkey")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("sk").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("sk")

    # A running value is missing until its week has a value, so the last week with one is kept beside each sum.
    last = {c: F.max(F.when(F.col(c).isNotNull(), F.col("week"))) for c in ("q", "dx", "dy")}
    months = lines.groupBy("sk", "month").agg(
        F.count("*").alias("wn"), F.sum("q").alias("wq"), F.sum("dx").alias("wx"), F.sum("dy").alias("wy"),
        *[e.alias(f"{c}_week") for c, e in last.items()],
    )
    carry = months.select(
        "sk",
        "month",
        F.sum("wn").over(whole).alias("n"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("wn", "wq", "wx", "wy")],
        *[F.max(f"{c}_week").over(earlier).alias(f"{c}_week0") for c in last],
    )

    def upto_row(c: str, before: str) -> Column:
        held = F.greatest(f"{c}_week", f"{c}_week0") == F.col("week")
        return F.when(held, F.coalesce(F.col(c), F.lit(0)) + F.col(before))

    pos = (
        lines.withColumn("i", F.row_number().over(inside) - 1)
        .withColumns({f"{c}_week": e.over(upto) for c, e in last.items()})
        .withColumns({c: F.sum(c).over(upto) for c in last})
        .join(carry.hint("shuffle_hash"), ["sk", "month"])
        .select(
            "sk",
            "ln",
            "ep",
            "n",
            (F.col("i") + F.col("wn0")).alias("ri"),
            upto_row("q", "wq0").alias("cq"),
            upto_row("dx", "wx0").cast("double").alias("cx"),
            upto_row("dy", "wy0").cast("double").alias("cy"),
        )
    )
    sk, ri, cq, cx, cy = (F.col(c) for c in ("sk", "ri", "cq", "cx", "cy"))
    rows = pos.select(
        series_name(sk).alias("well_id"),
        ri.cast("int").alias("row_idx"),
        F.when(sk % 10 == 9, "test").otherwise("train").alias("split"),
        (1000.0 + cq).alias("md"),
        (sk * 10.0 + cx).alias("x"),
        (sk * 5.0 + cy).alias("y"),
        (-9000.0 - cq / 64 + cx / 8).alias("z"),
        F.when((F.col("ln") == 7) & (ri % 3 == 0), None)
        .otherwise(30.0 + F.floor("ep") % 120)
        .cast("double")
        .alias("gr"),
        (5000.0 + sk * 4 + cq / 32 + cy / 4).alias("tvt"),
        "sk",
        "n",
    )
    plane = F.col("x") / 64 + F.col("y") / 32
    tops = [-9050.0, -9080.0, -9110.0, -9140.0, -9170.0, -9200.0]
    return rows.select(
        *rows.columns[:9],
        F.when(F.col("row_idx") < F.floor(F.col("n") * 3 / 5), F.col("tvt")).alias("tvt_input"),
        *[F.when(F.col("sk") % 20 != 0, top + plane).alias(f) for f, top in zip(FORMATIONS, tops)],
    )


def csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the series and curves as CSV files, written once; with what readers meet in files from elsewhere.

    Train files have a column of quoted notes with commas, quotes and line feeds. Test files have their columns in another
    order, no target and no formations, and their curves no signal. A missing signal is blank or ``NaN``, and some are
    the text ``n.v.``, which is no number.
    """

    def write(path: str) -> None:
        i, gr = F.col("row_idx"), F.col("gr")
        text = (
            F.when(gr.isNull(), F.when(i % 2 == 0, F.lit("NaN"))).when(i % 101 == 7, F.lit("n.v.")).otherwise(gr.cast("string"))
        ).alias("GR")
        note = F.when(i % 97 == 3, F.lit('lost, "tool"\n\nand back')).otherwise(F.concat(F.lit("row "), i.cast("string"))).alias("Note")
        names = {c.lower(): c for c in files.SERIES_COLUMNS}
        rows = series(spark, sf_dir)

        def named(*cols: str) -> list[Column]:
            return [F.col(c).alias(names[c]) for c in cols]

        train = rows.filter("split = 'train'").select("well_id", "row_idx", note, *named("md", "x", "y", "z"), text, *named("tvt", "tvt_input", *FORMATIONS))
        test = rows.filter("split = 'test'").select("well_id", "row_idx", *named("tvt_input"), text, *named("z", "y", "x", "md"))
        curves = reference(spark, sf_dir).join(rows.select("well_id", "split").distinct(), "well_id")
        curves = curves.select("well_id", "tw_idx", "split", F.col("tvt").alias("TVT"), F.col("gr").alias("GR"), F.col("geology").alias("Geology"))
        for split, part in (("train", train), ("test", test)):
            files.write_files(part, f"{path}/{split}/series", files.SERIES_SUFFIX)
            curve = curves.filter(F.col("split") == split).drop("split", *(["GR"] if split == "test" else []))
            files.write_files(curve, f"{path}/{split}/curves", files.REFERENCE_SUFFIX, "tw_idx")

    return folder_once(spark, f"csv:{sf_dir}", write)


def series_name(key: Column) -> Column:
    """Name of a series: its key with six digits at least. A longer key is never cut."""
    digits = key.cast("string")
    return F.concat(F.lit("w"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))


def series_number(well: str) -> Column:
    """The key inside a series name."""
    return F.expr(f"substring({well}, 2)").cast("bigint")


def _derive_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = 4096  # part keys per numbering chunk
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", "p_type")
    rows = pairs.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn(
        "chunk", F.floor(F.col("p_partkey") / span)
    )
    chunks = rows.groupBy("l_suppkey", "chunk").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("l_suppkey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("l_suppkey", "chunk", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("l_suppkey", "chunk").orderBy("p_partkey")
    idx = (F.col("i") + F.col("c0")).cast("int")
    return (
        rows.withColumn("i", F.row_number().over(inside) - 1)
        .join(offsets, ["l_suppkey", "chunk"])
        .select(
            series_name(F.col("l_suppkey")).alias("well_id"),
            idx.alias("tw_idx"),
            (4900.0 + F.col("l_suppkey") * 4 + idx * 4).alias("tvt"),
            (30.0 + F.floor(F.col("p_retailprice") * 13 + F.col("p_size") * 7) % 120).cast("double").alias("gr"),
            F.col("p_type").alias("geology"),
        )
    )


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold table of two simple models, ``y_pred`` and ``y_pred_b``, for the unknown rows of train series."""
    from lodeline.operators.anchors import with_anchors

    rows = with_anchors(series(spark, sf_dir).filter("split = 'train'"), "z_cut", "md_cut")
    return rows.filter("tvt_input IS NULL").select(
        "well_id",
        "row_idx",
        (series_number("well_id") % 5).cast("int").alias("fold"),
        (F.col("tvt") - F.col("last_known")).alias("y_true"),
        (F.col("z") - F.col("z_cut")).alias("y_pred"),
        ((F.col("md") - F.col("md_cut")) / 32).alias("y_pred_b"),
        F.col("last_known").alias("baseline"),
    )
