"""The folder shared by driver and executors, lineage cuts through it, and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if a count shows that it has at most this many (narrow) rows.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset, a single machine gets a folder of our own; a cluster must set it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="arbordex-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(path, its file system) as Hadoop objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/arbordex/{name}-{uuid.uuid4().hex}"
    p, fs = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


_SCRATCH = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: short lineage, and readable by any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._arbordex_path = path
    if getattr(_SCRATCH, "tables", None) is not None:
        _SCRATCH.tables.append(found)
    return found


def release(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing lazy reads them any more."""
    for df in tables:
        p, fs = hadoop_path(df.sparkSession, df._arbordex_path)
        fs.delete(p, True)


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


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
