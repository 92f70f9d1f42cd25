"""Exact dedup by a tree-merge of sorted digest runs (operator 1, DataFrame functions only).

Each row hashes its normalised text once. Rows are dealt to runs by a hash of their id, so that a text of which a third
of all rows are copies is spread over all runs; copies that meet within a run are one entry from the start (partial sums).
A run is sorted by digest and cut into slices by the digest's first bits, so that no run is one task's work, not even the
last. Runs are exchanged in binomial rounds: in each, the runs whose number has the low bits of the round set go to the
run that has them cleared, `fan_in` at a time. There the sorted runs are merged multiway (one sort by digest, which finds
its input in sorted pieces), entries of one digest stand side by side, and one stays with the best identifier and the sum
of the counts. An entry is the same only if SHA-256, byte length and an independent 64-bit hash all agree: a retained
identifier is one whose text agreed in all three with each text merged into it. The last run is every digest in order,
slice after slice. The decisions go down again: the last run joins the first level by digest (at most one entry per run
and digest), and that joins the rows by (run, digest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbordex.llm._common import ascii_lower, if_small, partitions, table, written

_KEY = ["__digest", "__bytes", "__check"]
#: Runs that are merged at a time: two binomial rounds in one exchange.
FAN_IN = 4


def run_count(spark: SparkSession, fan_in: int = FAN_IN) -> int:
    """Runs of the first level: a power of fan_in that follows the session's shuffle partitions (64 at least)."""
    n = 1
    while n < max(64, partitions(spark)):
        n *= fan_in
    return n


def merged(runs: DataFrame, step: int, keep: str) -> DataFrame:
    """Runs (__run, __slice, digest entries) with every `step` neighbours merged into one, each sorted by digest.

    The exchange sends entries by (run, slice); after the sort, one pass keeps the first entry of each digest.
    """
    order = F.asc_nulls_last("__keep") if keep == "smallest" else F.desc_nulls_last("__keep")
    met = runs.withColumn("__run", F.floor(F.col("__run") / step).cast("int")).repartition(partitions(runs.sparkSession), "__run", "__slice")
    same = Window.partitionBy("__run", "__slice", *_KEY)  # of neighbours in the order: at most `step` entries
    first = met.sortWithinPartitions("__run", "__slice", *_KEY, order)
    first = first.withColumn("__place", F.row_number().over(same.orderBy(order)))
    first = first.withColumn("__n", F.sum("__n").over(same.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return first.filter("__place = 1").drop("__place")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z only; a null text equals the empty one. keep: 'smallest' or
    'largest' id of a group stays. Null ids lose to all others (keep_id is null only if every id of the group is).
    Rows that repeat the kept id all say kept=true and all count in group_size. Other columns are not read. An empty
    table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    spark = docs.sparkSession
    best = F.min if keep == "smallest" else F.max
    runs = run_count(spark, fan_in)
    text = docs.select(docs[id_col].alias("__id"), ascii_lower(docs[text_col]).alias("__t"))
    rows = written(
        text.select(
            "__id",
            F.unhex(F.sha2("__t", 256)).alias("__digest"),
            F.octet_length("__t").alias("__bytes"),
            F.xxhash64("__t").alias("__check"),
            F.pmod(F.xxhash64("__id"), F.lit(runs)).cast("int").alias("__run"),
        ),
        "digests",
    )
    first = rows.groupBy("__run", *_KEY).agg(best("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    level, left = first.withColumn("__slice", F.conv(F.substring(F.hex("__digest"), 1, 2), 16, 10).cast("int")), runs
    while left > 1:
        level, left = merged(level, fan_in, keep), -(-left // fan_in)
    top = level.select(*_KEY, F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"))
    down = first.select("__run", *_KEY).join(top, _KEY)
    return rows.join(down, ["__run", *_KEY]).select(
        F.col("__id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, one per distinct normalised text, with all their columns, whatever their names.

    Of rows that repeat both the kept id and its text, one (any) stays; null ids and texts as in duplicates(). Texts
    are moved once at most: the rows that go (id and digest) are joined with them, broadcast if a count shows that they
    are few.
    """
    found = duplicates(docs, id_col, text_col, keep).select(F.col(id_col).alias("__go_id"), F.unhex("text_sha256").alias("__go_sha"), "kept")
    found = written(found, "decisions")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].alias("__id"), F.unhex(F.sha2(ascii_lower(docs[text_col]), 256)).alias("__sha"))

    def on(keys: DataFrame) -> Column:
        return (rows["__sha"] == keys["__go_sha"]) & rows["__id"].eqNullSafe(keys["__go_id"])

    gone = if_small(found.filter("not kept").select("__go_id", "__go_sha").distinct())
    kept = rows.join(gone, on(gone), "left_anti")
    repeated = found.filter("kept").groupBy("__go_id", "__go_sha").count().filter("count > 1").select("__go_id", "__go_sha")
    if repeated.limit(1).count():
        repeated = if_small(repeated)
        kept = kept.join(repeated, on(repeated), "left_anti").unionByName(rows.join(repeated, on(repeated), "left_semi").dropDuplicates(["__id", "__sha"]))
    return kept.select("__row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = {
    "op1_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)""",
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
