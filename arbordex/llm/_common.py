"""Shared plumbing of the training-data operators: the shared folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A side is broadcast only if a count shows that it has at most this many rows (of a few dozen bytes each).
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a single machine gets one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="arbordex-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Hadoop deletes it when the application ends."""
    path = f"{shared_dir(spark)}/arbordex/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_SCRATCH = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and any executor (a new one too) can read it again."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(schema).parquet(path)
    found._arbordex_path = path
    if getattr(_SCRATCH, "tables", None) is not None:
        _SCRATCH.tables.append(found)
    return found


def release(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing lazy reads them any more."""
    for df in tables:
        drop_path(df.sparkSession, df._arbordex_path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that written() makes in here are deleted at the end, but for those handed to the function that this gives."""
    outer, _SCRATCH.tables = getattr(_SCRATCH, "tables", None), []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._arbordex_path)
        if outer is not None:
            outer.append(df)
        return df

    try:
        yield keep
    finally:
        made, _SCRATCH.tables = _SCRATCH.tables, outer
        release(*[df for df in made if df._arbordex_path not in kept])


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until df has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH_BYTES unless it was set to other than Spark's default.

    A batch of whole texts lies in the executor's and in the Python worker's memory at once, for every running task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(key)).lower().rstrip("b") in ("67108864", "64m"):
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if at most `rows` rows are in it (counted, not estimated); else df itself.

    The count stops after rows + 1 rows, so it stays cheap for large tables. Without the hint, Spark's
    shuffle join (split by AQE where a key is hot) does the same work.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.

    translate() looks every character up, so texts of ASCII alone (where both agree) take lower()'s fast path.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
