"""Statistics of query runs: sums, maxima and picked (not interpolated) percentiles of the last 1024."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST = 1024


def report(runs: DataFrame, measures: list[str], by: str = "seq") -> DataFrame:
    """(measure, total, most, p50, p99) of runs: sum and maximum over all, percentiles over the LAST latest.

    A percentile is the element at n * p / 100 (rounded down) of the sorted values; 0 if there are none.
    """
    recent = runs.orderBy(F.desc(by)).limit(LAST)
    lists = recent.agg(*[F.array_sort(F.collect_list(m)).alias(m) for m in measures])  # LAST values each
    whole = runs.agg(*[F.struct(F.sum(m).alias("s"), F.max(m).alias("m")).alias(f"__{m}") for m in measures])
    at = lambda m, p: F.coalesce(F.get(F.col(m), F.floor(F.size(m) * p / 100).cast("int")), F.lit(0)).cast("long")
    row = lambda m: F.struct(F.lit(m).alias("measure"), F.coalesce(F.col(f"__{m}.s"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.col(f"__{m}.m"), F.lit(0)).cast("long").alias("most"), at(m, 50).alias("p50"), at(m, 99).alias("p99"))
    one = F.lit(1).alias("__one")  # one row meets one row
    return whole.select(one, "*").join(lists.select(one, "*"), "__one").select(F.inline(F.array(*[row(m) for m in measures])))
