"""Mixing sources to target weights by Poisson replication (operator 6, DataFrame functions only).

A source whose target mass is rate times its present mass repeats each of its documents Poisson(rate) times. The count
inverts the Poisson distribution function at a uniform number hashed from seed and document, so it depends on nothing
but the document and its source's rate: a lost executor's task gives the same rows again, and adding documents to one
source reshuffles no other. Rates over 16 are sums of independent parts of at most 16 each (Poisson variables add), so
that each distribution table has 96 entries at most and exp() never underflows. Copies are exploded and dealt out by a
hash of (seed, document, copy), and sorted by it within partitions: a global shuffle in one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm._common import if_small, partitions, table, unused

_PART = 16.0
_STEPS = 96


def _uniform(*parts: Column) -> Column:
    """52 bits of SHA-256 over the parts joined by '|' as a double in [0, 1)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, *, source_col: str = "source", temperature: float = 2.0, size: float = 1.0) -> DataFrame:
    """(__source, __rate): the mean number of copies of each document of a source.

    weights: target share by source (normalised over the sources present; a source not named gets none and vanishes).
    None: shares follow the temperature rule, present share to the power 1 / temperature. size: rows of the mix over
    rows of the input. A null source is a source of its own (named None in weights).
    """
    counts = docs.select(docs[source_col].alias("__source")).groupBy("__source").agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        share = F.sqrt(F.col("__n").cast("double")) if temperature == 2.0 else F.pow(F.col("__n").cast("double"), F.lit(1.0 / temperature))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        share = F.lit(float(weights.get(None, 0.0)))
        named = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        if named:
            share = F.when(F.col("__source").isNull(), share).otherwise(F.coalesce(F.element_at(F.create_map(*named), F.coalesce("__source", F.lit(""))), F.lit(0.0)))
    counts = counts.withColumn("__share", share)
    shares, rows = counts.agg(F.sum("__share"), F.sum("__n")).first()  # two numbers
    if not shares:
        return counts.select("__source", F.lit(0.0).alias("__rate"))
    return counts.select("__source", (F.col("__share") / F.lit(shares) * F.lit(rows) * F.lit(float(size)) / F.col("__n")).alias("__rate"))


def _copies(rate: Column, cdf: Column, seed: int, key: Column) -> Column:
    """Sum over the parts of a rate of the inverse distribution function at hashed uniform numbers."""
    parts = F.greatest(F.lit(1), F.ceil(rate / _PART)).cast("int")
    one = lambda i: F.size(F.filter(cdf, lambda c: c <= _uniform(F.lit(str(seed)), i.cast("string"), key)))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + one(i))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", temperature: float = 2.0, size: float = 1.0, seed: int = 17) -> DataFrame:
    """All columns of docs plus copy (from 0), copies and shuffle_key, in globally shuffled order.

    Rows with the same id and source get the same count (null ids count as the empty id); rows of an empty table,
    or of sources with target 0, give none. Columns of docs keep their values, whatever their names: where one is called
    copy, copies or shuffle_key, the new column's name gets underscores at its end.
    """
    spark = docs.sparkSession
    copy, copies, shuffle_key = (unused(docs, name) for name in ("copy", "copies", "shuffle_key"))
    table_ = rates(docs, weights, source_col=source_col, temperature=temperature, size=size).withColumn(
        "__each", F.col("__rate") / F.greatest(F.lit(1.0), F.ceil(F.col("__rate") / _PART))
    )
    state = F.struct(F.exp(-F.col("__each")).alias("p"), F.exp(-F.col("__each")).alias("c"), F.array(F.exp(-F.col("__each"))).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * F.col("__each") / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    table_ = table_.select("__source", "__rate", F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), state, step, lambda s: s["all"]).alias("__cdf"))
    key = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    salts = max(32, partitions(spark))  # a source of a third of all rows goes to so many tasks
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[source_col].alias("__of"), key.alias("__key"), F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("__salt"))
    table_ = if_small(table_.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), 200_000)
    counted = rows.join(table_, rows["__of"].eqNullSafe(table_["__source"]) & (rows["__salt"] == table_["__salt"])).withColumn("__copies", _copies(F.col("__rate"), F.col("__cdf"), seed, F.col("__key")))
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col("__key"), F.col("__copy").cast("string")), 256)
    return (
        counted.filter("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
        .select("__row.*", F.col("__copy").alias(copy), F.col("__copies").alias(copies), order.alias(shuffle_key))
        .repartition(partitions(spark), shuffle_key)
        .sortWithinPartitions(shuffle_key)
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = {
    "op6_mix_sources": f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS share FROM documents GROUP BY source),
r AS (SELECT source, share / (SELECT sum(share) FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c),
e AS (SELECT source, rate, CAST(greatest(1, ceil(rate / 16.0)) AS INTEGER) AS parts, rate / greatest(1, ceil(rate / 16.0)) AS each FROM r),
cdf AS (SELECT source, 0 AS k, exp(-each) AS p, exp(-each) AS acc, each FROM e
  UNION ALL SELECT source, k + 1, p * each / (k + 1), acc + p * each / (k + 1), each FROM cdf WHERE k < {_STEPS}),
lists AS (SELECT source, list(acc ORDER BY k) AS cdf FROM cdf GROUP BY source),
d AS (SELECT d.*, e.parts, lists.cdf FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN lists ON d.source IS NOT DISTINCT FROM lists.source),
u AS (SELECT *, list_sum([len([x FOR x IN cdf IF x <= CAST(('0x' || substr(sha256('17|' || i || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0]) FOR i IN range(1, parts + 1)]) AS copies FROM d),
x AS (SELECT *, unnest(range(0, CAST(copies AS BIGINT))) AS cp FROM u WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(cp AS INTEGER) AS "copy", CAST(copies AS INTEGER) AS copies,
  sha256('17|order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(cp AS VARCHAR)) AS shuffle_key FROM x""",
}
QUERIES = {"op6_mix_sources": op6_mix_sources}
