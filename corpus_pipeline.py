"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage works on all that the one before kept, written as Parquet in the shared folder and read again. Stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbordex.llm import exact_dedup, jaccard, mixing, packing, toxicity
from arbordex.llm._common import release, scratch, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the grammar, learned from labels, scores below 0.5. Null and empty texts stay."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (equal but for the case of A-Z): that of the smallest doc_id."""
    return exact_dedup.deduplicate(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of its five-word shingles: that of the smallest doc_id."""
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) so that sources get the square root of their share; globally shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The grammar's lexicon, the tokenizer and the packer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # a stage's tables go once what it keeps is written
            docs = keep(written(stage(spark, docs, sf_dir), name))
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
