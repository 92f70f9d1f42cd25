"""Following a change log with Structured Streaming: append, fold, publish, compact.

Each micro-batch's real changes are appended to the current generation's log (under the batch's number, so a batch that
runs again replaces itself), and the overlay is that log folded over the base. The log never passes 5 % of the base by
more than one batch: then the view is compacted to a new snapshot with an empty log.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbordex.engine import Catalog, NeedsFullIndex
from arbordex.operators import overlay as O
from arbordex.operators import tree
from arbordex.sources import raw, snapshots
from arbordex.storage import hadoop_path, written

EVENTS = "volume string, usn long, op string, frn long, parent_frn long, name string, is_dir boolean, is_auxiliary boolean, next_usn long"
DEBOUNCE = "500 milliseconds"


@dataclass
class Follower:
    """Keeps the catalog in `path` (see snapshots) up to date. rebuild: records for a full index when one is needed."""

    spark: SparkSession
    path: str
    rebuild: object = None
    own_names: list[str] = field(default_factory=list)
    catalog: Catalog | None = None
    full_indexes: int = 0
    compactions: int = 0

    def _log(self, generation: int) -> str:
        return f"{self.path}/log/g{generation}"

    def on_batch(self, batch: DataFrame, number: int) -> None:
        base, meta = snapshots.load(self.spark, self.path)
        log = self._log(meta["generation"])
        if raw.lost_data(batch).limit(1).count():
            self._index_anew(batch, meta)
            return
        new = raw.real_changes(batch, self.own_names).filter(F.col("usn") >= meta["next_usn"])
        new.write.mode("overwrite").parquet(f"{log}/batch={number}")
        changes = written(self.spark.read.schema(EVENTS).option("basePath", log).parquet(f"{log}/batch=*").drop("batch"), "log")
        # Appending a batch twice under two numbers (a lost checkpoint) must not fold it twice.
        changes = changes.dropDuplicates(["volume", "usn"])
        try:
            found = Catalog(base, None, meta["next_usn"], meta["generation"]).apply(changes, real=True)
        except NeedsFullIndex:
            self._index_anew(batch, meta)
            return
        if O.exceeds_threshold(changes.count(), meta["records"]):
            self._replace(found.compact().base, batch, meta)
            self.compactions += 1
        else:
            self.catalog = found
            found.save_overlay(self.path)

    def _index_anew(self, batch: DataFrame, meta: dict) -> None:
        if self.rebuild is None:
            raise NeedsFullIndex("events were lost or can't be folded, and there is nothing to rebuild from")
        self._replace(tree.build(self.rebuild()), batch, meta)
        self.full_indexes += 1

    def _replace(self, base: DataFrame, batch: DataFrame, meta: dict) -> None:
        last = batch.agg(F.max(F.coalesce("next_usn", F.col("usn") + 1))).first()[0]
        snapshots.save(base, self.path, max(meta["next_usn"], last or 0))
        self.catalog = Catalog.open(self.spark, self.path)

    def start(self, events: DataFrame, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
        """events: a streaming DataFrame of EVENTS. Offsets (the cursor) are in checkpoint."""
        trigger = {"availableNow": True} if available_now else {"processingTime": DEBOUNCE}
        return events.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = 64, bytes_per_trigger: int | None = None) -> DataFrame:
    """A change log of Parquet files as a stream, a bounded number of files (or of bytes, if given) at a time."""
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger or 64)
    return spark.readStream.schema(EVENTS).option(*limit).parquet(path)


def purge_log(spark: SparkSession, path: str, before_generation: int) -> None:
    """Delete logs of generations that no snapshot needs any more."""
    for g in range(1, before_generation):
        p, fs = hadoop_path(spark, f"{path}/log/g{g}")
        fs.delete(p, True)


@dataclass
class PersistSchedule:
    """When to store an idle catalog: 10 minutes after the last structural change; a moved cursor alone, after an hour;
    not again within 5 minutes of an attempt. Times are seconds of any clock that the caller passes in."""

    quiet: float = 600
    cursor_age: float = 3600
    retry: float = 300
    dirty: float | None = None
    changed: float | None = None
    tried: float | None = None

    def observe(self, now: float, structural: bool, cursor: bool) -> None:
        if (structural or cursor) and self.dirty is None:
            self.dirty = now
        if structural:
            self.changed = now

    def due(self, now: float) -> bool:
        since, wait = (self.dirty, self.cursor_age) if self.changed is None else (self.changed, self.quiet)
        if since is None or now - since < wait:
            return False
        return self.tried is None or now - self.tried >= self.retry

    def attempted(self, now: float) -> None:
        self.tried = now

    def persisted(self) -> None:
        self.dirty = self.changed = self.tried = None
