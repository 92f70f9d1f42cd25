"""Sets of half-open intervals of preorder positions, and the searches below matching directories that they answer.

All of them are sweeps: starts and ends become points, points are put in order by a range-partitioned sort, and a running
sum over it (see ordinals.ranked) is the depth at each point. No interval is joined with another by a range condition, and
nothing needs a volume's intervals in one task.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordex.operators.ordinals import ranked
from arbordex.operators.search import filter_column
from arbordex.plans.qlang import MAX_TERMS, Query, ascii_lower


def _points(intervals: DataFrame) -> DataFrame:
    """(volume, at, step): +1 at each start, -1 at each end, summed where points coincide. Empty intervals have none."""
    some = intervals.filter(F.col("start") < F.col("end")).select("volume", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("p"))
    return some.groupBy("volume", F.col("p.at").alias("at")).agg(F.sum("p.step").alias("step"))


def _covered(points: DataFrame, least: int) -> DataFrame:
    """(volume, start, end): maximal intervals in which the depth is `least` or more."""
    depth = ranked(points, ["at"], "__i", running={"__opened": "step"}).withColumn("__after", F.col("__opened") + F.col("step"))
    edge = (F.col("__opened") >= least) != (F.col("__after") >= least)
    edges = ranked(depth.filter(edge).select("volume", "at"), ["at"], "__i")  # starts and ends take turns
    pair = edges.groupBy("volume", F.floor(F.col("__i") / 2).alias("__pair")).agg(F.min("at").alias("start"), F.max("at").alias("end"))
    return pair.select("volume", "start", "end")


def normalise(intervals: DataFrame) -> DataFrame:
    """The union of (volume, start, end) as disjoint intervals that don't touch; null ends and empty intervals don't count."""
    return _covered(_points(intervals), 1)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalise(a.select("volume", "start", "end").unionByName(b.select("volume", "start", "end")))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where both cover: maximal disjoint intervals."""
    both = normalise(a).unionByName(normalise(b))
    return _covered(_points(both), 2)


def inside(rows: DataFrame, intervals: DataFrame, at: str = "dfs_pos") -> DataFrame:
    """The rows (volume, `at`, ...) whose position an interval covers, all their columns."""
    steps = _points(intervals).select("volume", F.col("at").alias("__at"), F.lit(0).alias("__late"), "step", F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("__row"))
    asks = rows.select("volume", F.col(at).alias("__at"), F.lit(1).alias("__late"), F.lit(0).cast("long").alias("step"), F.struct("*").alias("__row"))
    depth = ranked(steps.unionByName(asks), ["__at", "__late"], "__i", running={"__depth": "step"})
    return depth.filter((F.col("__late") == 1) & (F.col("__depth") > 0)).select("__row.*")


def term_intervals(catalog: DataFrame, term: str) -> DataFrame:
    """What lies in or below a directory whose own name has the term, as a set of intervals of dfs_pos."""
    hit = F.lit(False) if "\x00" in term else F.contains(F.col("lname"), F.lit(ascii_lower(term)))
    return normalise(catalog.filter(F.col("is_dir") & hit).select("volume", F.col("dfs_pos").alias("start"), F.col("dfs_end").alias("end")))


def below_terms(catalog: DataFrame, q: Query) -> DataFrame:
    """Records that match a term query: each term in the own name, or in the name of a directory above.

    Equal to search.compile_query()'s condition on dir_blob, but every term is one sweep over positions instead of a scan
    of all ancestors' names; only own matches and covered positions are kept, term by term, those of the rarest first as
    the caller orders them.
    """
    if not q.terms or len(q.terms) > MAX_TERMS:
        return catalog.limit(0)
    rows = catalog.withColumn("eff_kib", F.col("rec_kib")).filter(filter_column(q.filter)).drop("eff_kib")
    for term in dict.fromkeys(map(ascii_lower, q.terms)):
        if "\x00" in term:
            return catalog.limit(0)
        own = F.contains(F.col("lname"), F.lit(term))
        rows = rows.filter(own).unionByName(inside(rows.filter(~own), term_intervals(catalog, term)))
    return rows


def counts(view: DataFrame, condition: Column, limit: int) -> DataFrame:
    """(seen, candidates, emitted): rows that a search looks at, that match, and that it returns."""
    found = view.agg(F.count(F.lit(1)).alias("seen"), F.coalesce(F.sum(condition.cast("long")), F.lit(0)).alias("candidates"))
    return found.withColumn("emitted", F.least("candidates", F.lit(max(0, limit)).cast("long")))


