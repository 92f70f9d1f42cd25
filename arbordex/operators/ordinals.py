"""Global ordinals and running sums without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbordex.storage import if_small, partitions, written


def ranked(df: DataFrame, by: list[str], out: str, within: str = "volume", running: dict[str, str] | None = None) -> DataFrame:
    """df with `out`: position from 0 in the order of (within, *by) inside each `within`.

    Rows are range-partitioned and sorted, and numbered as they are written (so numbers are fixed, and no row is sorted or
    moved again); a number is shifted by the counts of the partitions before (one row a partition). running: new column to
    summed column, exclusive prefix sums in the same order.
    """
    spark = df.sparkSession
    running = running or {}
    order = [within, *by]
    fixed = written(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ordered")
    fixed = fixed.withColumn("__p", F.shiftright("__m", 33))  # the partition; the lower bits count its rows
    totals = fixed.groupBy("__p", within).agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"), *[F.sum(c).alias(f"__s_{o}") for o, c in running.items()])
    totals = written(totals, "totals")
    before = Window.partitionBy(within).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sums = [F.coalesce(F.sum(f"__s_{o}").over(before), F.lit(0)).alias(f"__b_{o}") for o in running]
    shift = totals.select("__p", within, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), *sums)
    rows = fixed
    inside = Window.partitionBy("__p", within).orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    for o, c in running.items():
        rows = rows.withColumn(o, F.coalesce(F.sum(c).over(inside), F.lit(0)))
    rows = rows.join(if_small(shift), ["__p", within]).withColumn(out, (F.col("__m") + F.col("__shift")).cast("long"))
    for o in running:
        rows = rows.withColumn(o, (F.col(o) + F.col(f"__b_{o}")).cast("long"))
    return rows.select(*[c for c in df.columns if c != out and c not in running], out, *running)


def live_ranks(catalog: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(volume, record, dead_before, live_rank): tombstones before each record, and its place among the live (null: dead)."""
    gone = if_small(tombstones.select("volume", "record").distinct().withColumn("__dead", F.lit(1)))
    rows = catalog.select("volume", "record").join(gone, ["volume", "record"], "left").withColumn("__dead", F.coalesce("__dead", F.lit(0)))
    rows = ranked(rows, ["record"], "__i", running={"dead_before": "__dead"})
    return rows.select("volume", "record", "dead_before", F.when(F.col("__dead") == 0, F.col("__i") - F.col("dead_before")).alias("live_rank"))


def lower_bound(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """(volume, name) of names with `bound`: how many records of the volume sort before the name (A-Z folded)."""
    from arbordex.functions.scalars import lname

    asked = if_small(names.select(F.col("volume").alias("__v"), "name", lname(F.col("name")).alias("__l")))
    hits = catalog.select("volume", "lname").join(asked, (F.col("volume") == F.col("__v")) & (F.col("lname") < F.col("__l")))
    counted = hits.groupBy("__v", "name").agg(F.count(F.lit(1)).alias("bound"))
    return asked.join(counted, ["__v", "name"], "left").select(F.col("__v").alias("volume"), "name", F.coalesce("bound", F.lit(0)).cast("long").alias("bound"))
