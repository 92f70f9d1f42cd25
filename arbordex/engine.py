"""The public interface: catalogs with their overlay, searches over one or many of them, as-you-type sessions."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.operators import intervals
from arbordex.operators import overlay as O
from arbordex.operators import search as X
from arbordex.operators import tree
from arbordex.plans import qlang
from arbordex.sources import raw, snapshots
from arbordex.storage import written

#: A refinement is only trusted if the scan before found fewer hits than this.
REFINE_CAP = 20_000
DEFAULT_LIMIT = 50


class NeedsFullIndex(RuntimeError):
    """The change log can't be folded into the overlay: build the catalog anew."""


class Catalog:
    """A base catalog (any number of volumes) and its overlay. Changes give a new generation; views never mix two."""

    def __init__(self, base: DataFrame, overlay: O.Overlay | None = None, next_usn: int = 0, generation: int = 1) -> None:
        self.base, self.overlay, self.next_usn, self.generation = base, overlay, next_usn, generation
        self._view: DataFrame | None = None

    @classmethod
    def from_records(cls, records: DataFrame, next_usn: int = 0) -> Catalog:
        return cls(written(snapshots.sorted_by_name(tree.build(records)), "catalog"), None, next_usn)

    @classmethod
    def from_readers(cls, *readers: Callable[[], DataFrame]) -> Catalog:
        """from_records() of the first reader that can read; the last one's error if none can."""
        for n, reader in enumerate(readers, 1):
            try:
                return cls.from_records(reader())
            except Exception:
                if n == len(readers):
                    raise
        raise ValueError("no reader")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        """The stored snapshot with its stored overlay, if it has one."""
        base, meta = snapshots.load(spark, path)
        stored = snapshots.load_overlay(spark, path, base, meta["generation"])
        if stored is None:
            return cls(base, None, meta["next_usn"], meta["generation"])
        return cls(base, stored[0], stored[1]["next_usn"], meta["generation"])

    @classmethod
    def resume(cls, spark: SparkSession, path: str, events: DataFrame) -> Catalog:
        """The stored snapshot with all later events; NeedsFullIndex if they are more than 5 % of it."""
        base, meta = snapshots.load(spark, path)
        found = cls(base, None, meta["next_usn"], meta["generation"])
        later = written(raw.real_changes(raw.replay(events, found.next_usn)), "replay")
        if O.exceeds_threshold(later.count(), found.base.count()):
            raise NeedsFullIndex("too many changes")
        return found.apply(later, real=True)

    def save(self, path: str) -> int:
        """Store the base, with the overlay compacted into it."""
        return snapshots.save((self.compact() if self.overlay else self).base, path, self.next_usn)

    def save_overlay(self, path: str) -> None:
        """Store the overlay beside the stored snapshot that it lies over: open() then finds both, without folding anew."""
        base = snapshots.current(self.base.sparkSession, path)
        if self.overlay is not None and base is not None:
            snapshots.save_overlay(self.overlay, path, base=base["generation"], next_usn=self.next_usn)

    def live_count(self) -> DataFrame:
        """(volume, live): records that searches can find."""
        return self.view().groupBy("volume").agg(F.count(F.lit(1)).alias("live"))

    def view(self) -> DataFrame:
        if self._view is None:
            self._view = X.base_view(self.base) if self.overlay is None else written(O.view(self.base, self.overlay), "view")
        return self._view

    def apply(self, events: DataFrame, *, real: bool = False, own_names: list[str] | None = None) -> Catalog:
        """A catalog with the base's whole change log `events` as its overlay."""
        if not real and raw.lost_data(events).limit(1).count():
            raise NeedsFullIndex("the reader lost events")
        changes = events if real else raw.real_changes(events, own_names)
        folded = O.fold(self.base, changes)
        if folded.reindex.limit(1).count():
            raise NeedsFullIndex("an event names an unknown parent or id")
        last = changes.agg({"usn": "max"}).first()[0]
        return Catalog(self.base, folded, self.next_usn if last is None else last + 1, self.generation + 1)

    def compact(self, follow_frn: bool = False) -> Catalog:
        if self.overlay is None:
            return self
        return Catalog(written(snapshots.sorted_by_name(tree.build(O.compacted(self.base, self.overlay, follow_frn))), "catalog"), None, self.next_usn, self.generation + 1)


class Engine:
    """Searches over catalogs. slots: volume to slot number, the tie-break between volumes."""

    def __init__(self, catalog: Catalog, slots: dict[str, int] | None = None) -> None:
        self.catalog, self.slots = catalog, slots or {}

    def query(self, text: str | qlang.Query, kind: str | None = None, now: int | None = None) -> qlang.Query:
        return text if isinstance(text, qlang.Query) else qlang.to_query(text, int(time.time()) if now is None else now, kind)

    def hits(self, text: str | qlang.Query, kind: str | None = None, order: str = "relevance", limit: int = DEFAULT_LIMIT, now: int | None = None) -> DataFrame:
        return X.hits(self.catalog.view(), self.query(text, kind, now), qlang.parse_order(order), limit, self.slots)

    def search(self, text: str | qlang.Query, kind: str | None = None, order: str = "relevance", limit: int = DEFAULT_LIMIT, now: int | None = None) -> DataFrame:
        return X.search(self.catalog.view(), self.query(text, kind, now), qlang.parse_order(order), limit, self.slots)

    def paths(self, found: DataFrame) -> DataFrame:
        """Hits of this catalog with their paths."""
        return X.materialise(self.catalog.view(), found)

    def scan(self, text: str | qlang.Query, kind: str | None = None, limit: int = DEFAULT_LIMIT, now: int | None = None, in_order: bool = True) -> DataFrame:
        return X.scan(self.catalog.view(), self.query(text, kind, now), limit, in_order=in_order)

    def counts(self, text: str | qlang.Query, kind: str | None = None, limit: int = DEFAULT_LIMIT, now: int | None = None) -> DataFrame:
        """(seen, candidates, emitted) of a search."""
        return intervals.counts(self.catalog.view(), X.compile_query(self.query(text, kind, now))[0], X.clamp(limit))

    def stats(self) -> dict:
        """Generation, cursor and live records by volume."""
        return {"generation": self.catalog.generation, "next_usn": self.catalog.next_usn, "live": {r["volume"]: r["live"] for r in self.catalog.live_count().collect()}}

    def prefix(self, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.search(text, "prefix", limit=limit)

    def substring(self, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.search(text, "substring", limit=limit)

    def wildcard(self, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.search(text, "wildcard", limit=limit)

    def path_terms(self, text: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return self.search(text, "path_terms", limit=limit)

    def register_views(self) -> None:
        """Temporary SQL views: records (the base catalog) and paths (the view's paths)."""
        self.catalog.base.createOrReplaceTempView("records")
        self.catalog.view().select("volume", "record", "path").createOrReplaceTempView("paths")


class LocalSearch:
    """Searches over the newest stored catalog of a folder, looked up again once the one at hand is `stale` seconds old."""

    def __init__(self, spark: SparkSession, path: str, stale: float = 0.25, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.path, self.stale, self.clock = spark, path, stale, clock
        self._engine: Engine | None = None
        self._seen: tuple = ()
        self._looked = 0.0

    def engine(self) -> Engine:
        now = self.clock()
        if self._engine is None or now - self._looked >= self.stale:
            seen = tuple((m or {}).get("folder") for m in (snapshots.current(self.spark, self.path, k) for k in ("CURRENT", "OVERLAY")))
            if self._engine is None or seen != self._seen:
                self._engine, self._seen = Engine(Catalog.open(self.spark, self.path)), seen
            self._looked = now
        return self._engine

    def search(self, text: str | qlang.Query, kind: str | None = None, order: str = "relevance", limit: int = DEFAULT_LIMIT, now: int | None = None) -> DataFrame:
        return self.engine().search(text, kind, order, limit, now)


def is_refinement(old: qlang.Query, new: qlang.Query) -> bool:
    """Each old term is a prefix of the new term at its place; more terms may follow. Text queries likewise."""
    if old.kind != new.kind or old.filter or new.filter:
        return False
    if old.kind == "path_terms":
        pairs = list(zip(old.terms, new.terms, strict=False))
        return 0 < len(old.terms) <= len(new.terms) and all(qlang.ascii_lower(b).startswith(qlang.ascii_lower(a)) for a, b in pairs)
    return old.kind in ("prefix", "substring") and bool(old.text) and qlang.ascii_lower(new.text).startswith(qlang.ascii_lower(old.text))


@dataclass
class _Cached:
    generation: int
    order: str
    query: qlang.Query
    rows: DataFrame


class Session:
    """As-you-type searches: the newest request wins, older ones are cancelled and answer nothing.

    A request that refines the one before filters that one's candidates (view rows, written out), if there were fewer
    than REFINE_CAP of them and the catalog is still the same generation.
    """

    def __init__(self, engine: Engine, order: str = "relevance", limit: int = 12) -> None:
        self.engine, self.order, self.limit = engine, qlang.parse_order(order), limit
        self._spark = engine.catalog.base.sparkSession
        self._number = 0
        self._done = threading.Condition()
        self._result: tuple[int, list | None] = (0, None)
        self._error: BaseException | None = None
        self._cache: _Cached | None = None
        self.refined = 0

    def set_order(self, order: str) -> None:
        self.order = qlang.parse_order(order)

    def set_limit(self, limit: int) -> None:
        self.limit = limit

    def candidates(self, q: qlang.Query, order: str) -> DataFrame:
        """View rows among which all of q's matches are."""
        view, generation = self.engine.catalog.view(), self.engine.catalog.generation
        c = self._cache
        if c and c.generation == generation and c.order == order and is_refinement(c.query, q):
            self.refined += 1
            view = c.rows
        found, _ = X.compile_query(q)
        some = view.filter(found).limit(REFINE_CAP)
        rows = written(some, "candidates")
        if rows.count() < REFINE_CAP and (q.kind in ("prefix", "substring") or (q.kind == "path_terms" and not q.filter)):
            self._cache = _Cached(generation, order, q, rows)
            return rows
        self._cache = None
        return view

    def submit(self, text: str, kind: str | None = None, now: int | None = None) -> int:
        """Start a request in the background; requests before it are superseded."""
        with self._done:
            self._number += 1
            number = self._number
        self._spark.sparkContext.cancelJobGroup(f"session-{id(self)}-{number - 1}")
        q, order, limit = self.engine.query(text, kind, now), self.order, self.limit

        def run() -> None:
            self._spark.sparkContext.setJobGroup(f"session-{id(self)}-{number}", text, interruptOnCancel=True)
            rows, error = None, None
            try:
                if number == self._number:
                    rows = X.search(self.candidates(q, order), q, order, limit, self.engine.slots).collect()  # `limit` rows
            except Exception as e:  # told to the waiter, unless superseded
                error = e
            with self._done:
                if number == self._number:
                    self._result, self._error = (number, rows), error
                    self._done.notify_all()

        threading.Thread(target=run, daemon=True).start()
        return number

    def is_pending(self) -> bool:
        return self._result[0] < self._number

    def poll_latest(self) -> list | None:
        """Rows of the newest request; None while it runs."""
        return None if self.is_pending() else self._result[1]

    def wait_latest(self, timeout: float | None = None) -> list:
        with self._done:
            if not self._done.wait_for(lambda: not self.is_pending(), timeout):
                raise TimeoutError
            if self._error:
                raise self._error
            return self._result[1] or []
