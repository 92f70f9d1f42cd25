"""Versioned snapshots of a catalog: Parquet by volume, sorted by folded name, published by a pointer file.

A snapshot is written to a folder of its own first; readers see it only once a pointer names it: pointers are numbered,
appear by one rename, and the newest counts. Overlays are stored beside their base in the same way. Each snapshot holds one row of meta data: format, generation, records and the journal cursor.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.operators.overlay import ADDED, Overlay
from arbordex.storage import hadoop_path, partitions

FORMAT = 1
#: Additions that a stored overlay may have; more of them mean a damaged one (it is compacted long before).
MAX_ADDED = 1 << 32
_POINTER = "CURRENT"


class BadOverlay(ValueError):
    """A stored overlay that no fold can have made: it is rejected."""


class WrongFormat(ValueError):
    """The snapshot has another format: it is rejected, not migrated."""


def _put(spark: SparkSession, path: str, text: str) -> None:
    p, fs = hadoop_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def sorted_by_name(catalog: DataFrame) -> DataFrame:
    """catalog range-partitioned and sorted by (volume, lname): row groups then hold narrow ranges of names."""
    spark = catalog.sparkSession
    return catalog.repartitionByRange(partitions(spark), "volume", "lname").sortWithinPartitions("volume", "lname")


def save(catalog: DataFrame, path: str, next_usn: int = 0) -> int:
    """Write a new generation and publish it; returns its number. Readers of older ones are not disturbed."""
    spark = catalog.sparkSession
    generation = (current(spark, path) or {"generation": 0})["generation"] + 1
    folder = f"g{generation}-{uuid.uuid4().hex[:8]}"
    sorted_by_name(catalog).write.partitionBy("volume").parquet(f"{path}/{folder}")
    n = spark.read.parquet(f"{path}/{folder}").count() if catalog.limit(1).count() else 0
    meta = {"format": FORMAT, "generation": generation, "folder": folder, "records": n, "next_usn": next_usn, "columns": catalog.schema.jsonValue()}
    publish(spark, path, meta)
    return generation


def _pointers(spark: SparkSession, path: str, kind: str) -> list[tuple[int, str]]:
    """(number, path) of the whole pointers of a kind, oldest first."""
    p, fs = hadoop_path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    found = [n.split("-") for n in names if n.startswith(f"{kind}-")]
    return sorted((int(n[1]), f"{path}/{'-'.join(n)}") for n in found if len(n) == 2 and n[1].isdigit())


def publish(spark: SparkSession, path: str, meta: dict, kind: str = _POINTER) -> None:
    """Add a pointer of the next number, written aside and renamed to a name that did not exist: the newest whole one counts.

    No pointer is ever replaced, so a reader finds the old or the new one at any time; older ones but the last go.
    """
    new = f"{path}/.{kind}-{uuid.uuid4().hex}"
    _put(spark, new, json.dumps(meta))
    source, fs = hadoop_path(spark, new)
    for _ in range(100):  # another writer may take the number
        there = _pointers(spark, path, kind)
        target, _ = hadoop_path(spark, f"{path}/{kind}-{there[-1][0] + 1 if there else 1}")
        if not fs.exists(target) and fs.rename(source, target):
            for _, old in there[:-1]:
                fs.delete(hadoop_path(spark, old)[0], False)
            return
    raise OSError(f"cannot publish {path}")


def current(spark: SparkSession, path: str, kind: str = _POINTER) -> dict | None:
    for _ in range(100):  # a pointer that was listed may be gone by now, for a newer one
        there = _pointers(spark, path, kind)
        if not there:
            return None
        text = _get(spark, there[-1][1])
        if text is not None:
            return json.loads(text)
    raise OSError(f"cannot read {path}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(catalog, meta) of the published snapshot; WrongFormat or FileNotFoundError otherwise."""
    from pyspark.sql.types import StructType

    meta = current(spark, path)
    if meta is None:
        raise FileNotFoundError(path)
    if meta.get("format") != FORMAT:
        raise WrongFormat(meta.get("format"))
    schema = StructType.fromJson(meta["columns"])
    if not meta["records"]:
        return spark.createDataFrame([], schema), meta
    return spark.read.schema(schema).parquet(f"{path}/{meta['folder']}").select(*schema.names), meta


def save_overlay(overlay: Overlay, path: str, *, base: int, next_usn: int) -> None:
    """Store an overlay over generation `base` in a folder of its own, and publish it by a pointer (as save() does)."""
    spark = overlay.added.sparkSession
    folder = f"overlay-{uuid.uuid4().hex[:8]}"
    for name in ("tombstones", "added", "reindex"):
        getattr(overlay, name).write.parquet(f"{path}/{folder}/{name}")
    sizes = {name: spark.read.parquet(f"{path}/{folder}/{name}").count() for name in ("tombstones", "added")}
    publish(spark, path, {"format": FORMAT, "folder": folder, "base": base, "next_usn": next_usn, **sizes}, "OVERLAY")


def load_overlay(spark: SparkSession, path: str, catalog: DataFrame, base: int) -> tuple[Overlay, dict] | None:
    """(overlay, meta) published for generation `base`, or None if there is none.

    BadOverlay if rows are missing, there are more than MAX_ADDED additions, an added parent does not come before its
    child, or a record does not exist in the catalog.
    """
    meta = current(spark, path, "OVERLAY")
    if meta is None or meta["base"] != base:
        return None
    if meta.get("format") != FORMAT:
        raise WrongFormat(meta.get("format"))
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{meta['folder']}/{name}")
    found = Overlay(read("tombstones", "volume string, record long"), read("added", ADDED), read("reindex", "volume string, usn long, frn long"))
    if meta["added"] > MAX_ADDED or any(getattr(found, name).count() != meta[name] for name in ("tombstones", "added")):
        raise BadOverlay("rows are missing, or too many")
    forward = (F.col("parent_kind") == "delta") & ((F.col("parent_idx") >= F.col("idx")) | (F.col("parent_idx") < 0) | F.col("parent_idx").isNull())
    if found.added.filter(forward).limit(1).count():
        raise BadOverlay("an added record's parent is not an earlier one")
    named = found.tombstones.select("volume", "record").unionByName(found.added.filter("parent_kind = 'base'").select("volume", F.col("parent_idx").alias("record")))
    if named.join(catalog.select("volume", "record"), ["volume", "record"], "left_anti").limit(1).count():
        raise BadOverlay("it names a record that the catalog does not have")
    return found, meta


def names_in(catalog: DataFrame, volume: str, first: int, end: int) -> DataFrame:
    """Names of records first .. end - 1 in name order."""
    return catalog.filter((F.col("volume") == volume) & F.col("record").between(first, end - 1)).orderBy("record").select("record", "name")


def name_of(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(volume, record, name) of wanted (volume, record); unknown numbers give no row."""
    return catalog.select("volume", "record", "name").join(wanted.select("volume", "record").distinct(), ["volume", "record"])


def by_frn(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(volume, frn, record) of wanted (volume, frn); unknown ids give no row."""
    return catalog.select("volume", "frn", "record").join(wanted.select("volume", "frn").distinct(), ["volume", "frn"])
