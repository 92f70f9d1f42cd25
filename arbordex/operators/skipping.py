"""Data skipping by trigrams: a side table of the trigrams of each block of records, and a semi-join on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordex.functions import scalars as S
from arbordex.storage import if_small

BLOCK_RECORDS = 1024


def block_index(catalog: DataFrame) -> DataFrame:
    """(volume, block_id, gram), each once."""
    return catalog.select("volume", F.floor(F.col("record") / BLOCK_RECORDS).cast("long").alias("block_id"), F.explode(S.trigrams(F.col("lname"))).alias("gram")).distinct()


def _grams(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def candidate_blocks(index: DataFrame, clauses: list[list[str]]) -> DataFrame | None:
    """(volume, block_id) of blocks that may hold, for each clause, one of its literals; None if no clause helps.

    A literal under three characters can't be looked up and makes its clause useless. Blocks of several terms of a path
    query are never intersected: terms may match in different blocks.
    """
    wanted: dict[str, int] = {}
    useful = [c for c in clauses if c and all(len(x) >= 3 for x in c)]
    if not useful:
        return None
    for c in useful:
        for x in c:
            for g in _grams(x):
                wanted.setdefault(g, len(wanted))
    have = index.filter(F.col("gram").isin(*wanted)).groupBy("volume", "block_id").agg(F.collect_set("gram").alias("have"))
    ok = F.lit(True)
    for c in useful:
        any_of = F.lit(False)
        for x in c:
            grams = F.array(*[F.lit(g) for g in _grams(x)])
            any_of = any_of | (F.size(F.array_except(grams, F.col("have"))) == 0)
        ok = ok & any_of
    return have.filter(ok).select("volume", "block_id")


def skipped(view: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """The rows of view in the given blocks (all of them for None)."""
    if blocks is None:
        return view
    few = if_small(blocks.select(F.col("volume").alias("__v"), F.col("block_id").alias("__b")))
    return view.join(few, (F.col("volume") == F.col("__v")) & (F.floor(F.col("record") / BLOCK_RECORDS) == F.col("__b")), "left_semi")
