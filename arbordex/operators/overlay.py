"""The mutable overlay of a catalog: folding change events, the combined view, compaction.

The fold is a state machine per external id (frn), but for parents: an event's parent is the version of the parent's frn
that lives at the event's time. Both parts are window functions: one over each frn's own events, one as-of lookup over
the events of parents. Whether a parent is known and whether a rename changes anything feed back on versions, so the
two are repeated until nothing changes (each round settles one more level of such nesting; two rounds are the rule).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbordex.functions import scalars as S
from arbordex.operators.ordinals import ranked
from arbordex.operators.search import base_view
from arbordex.operators.tree import SEPARATOR
from arbordex.storage import if_small, written

ADDED = (
    "volume string, idx long, frn long, usn long, name string, parent_kind string, parent_idx long, "
    "mtime long, is_dir boolean, size_bytes long, size_exact boolean, live boolean"
)


@dataclass
class Overlay:
    """tombstones (volume, record), added (see ADDED) and reindex: events (volume, usn, frn) that can't be folded."""

    tombstones: DataFrame
    added: DataFrame
    reindex: DataFrame


def _own(events: DataFrame) -> DataFrame:
    """State of each event's frn before it, and what the event does, given parent references (pk, pv) so far."""
    key = Window.partitionBy("volume", "frn").orderBy("usn")
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    op, known, in_base = F.col("op"), F.col("pk").isNotNull(), F.col("record").isNotNull()
    mark = (
        F.when(op == "created", F.when(known, True))
        .when(op == "deleted", False)
        .when(~known, False)
        .when(in_base, True)
    )
    rows = events.withColumn("__live", F.coalesce(last(mark), in_base))
    rows = rows.withColumn("__moved", F.coalesce(last(F.when(op != "created", True)), F.lit(False)))
    rows = rows.withColumn("__added", F.col("__live") & ~(in_base & ~F.col("__moved")))
    rename = (op == "renamed") & known & (F.col("__live") | in_base)
    make = ((op == "created") & known & ~F.col("__live")) | rename
    # A rename that repeats the current version makes one just like it: comparing with the last made is enough.
    rows = rows.withColumn("__make", make).withColumn("__ref", F.when(make, F.struct("name", "pk", "pv")))
    rows = rows.withColumn("__cur", last(F.col("__ref")))
    same = rename & F.col("__added") & F.col("__cur").eqNullSafe(F.struct("name", "pk", "pv"))
    rows = rows.withColumn("makes", make & ~F.coalesce(same, F.lit(False)))
    rows = rows.withColumn("version_before", last(F.when(F.col("makes"), F.col("usn"))))
    rows = rows.withColumn("version_before", F.when(F.col("__added"), F.col("version_before")))
    after = (
        F.when(F.col("makes"), F.col("usn"))
        .when(op == "created", F.col("version_before"))
        .when(rename, F.col("version_before"))
    )
    origin = F.when(F.col("makes") & (op == "created"), F.struct(F.lit(False).alias("base"), F.col("is_dir").alias("d")))
    origin = F.when(F.col("makes") & (op == "renamed") & ~F.col("__added"), F.struct(F.lit(True).alias("base"), F.lit(False).alias("d"))).otherwise(origin)
    rows = rows.withColumn("version", after).withColumn("__origin", origin)
    rows = rows.withColumn("origin", F.coalesce("__origin", last(F.col("__origin"))))
    lost = ((op == "created") & ~known & ~F.col("__live")) | ((op == "renamed") & ~(known & (F.col("__live") | in_base)))
    return rows.withColumn("lost", lost).drop("__live", "__moved", "__added", "__make", "__ref", "__cur", "__origin")


def _parents(rows: DataFrame) -> DataFrame:
    """rows with pk ('delta' or 'base'; null if unknown) and pv of each event's parent at its time."""
    empty = F.lit(None)
    facts = rows.select("volume", F.col("frn").alias("__key"), "usn", F.lit(0).alias("__ask"), F.coalesce("version", F.lit(-1)).alias("__alive"), empty.cast("long").alias("__who"))
    asks = rows.filter("op <> 'deleted'").select("volume", F.col("parent_frn").alias("__key"), "usn", F.lit(1).alias("__ask"), empty.cast("long").alias("__alive"), F.col("frn").alias("__who"))
    asof = Window.partitionBy("volume", "__key").orderBy("usn", F.desc("__ask")).rowsBetween(Window.unboundedPreceding, -1)
    seen = facts.unionByName(asks).withColumn("__v", F.last("__alive", ignorenulls=True).over(asof)).filter("__ask = 1")
    seen = seen.select("volume", F.col("__who").alias("frn"), "usn", F.when((F.col("__v") >= 0) & (F.col("__key") != F.col("__who")), F.col("__v")).alias("__v"))
    out = rows.drop("pk", "pv").join(seen, ["volume", "frn", "usn"], "left")
    return out.withColumn("pk", F.when(F.col("__v").isNotNull(), "delta").when(F.col("parent_record").isNotNull(), "base")).withColumn("pv", F.coalesce("__v", "parent_record")).drop("__v")


def fold(catalog: DataFrame, events: DataFrame) -> Overlay:
    """The overlay after events (volume, usn, op, frn, parent_frn, name, is_dir), usn unique in a volume.

    Created ids that live are left alone, unknown deleted ids too; renames keep metadata and do nothing if name and
    parent version stay; an unknown parent, or a rename of an unknown id, asks for a full index (`reindex`). Modified and
    other events do nothing. Deleting or renaming a directory does not touch what is below.
    """
    ids = catalog.select("volume", "frn", "record")
    ev = events.filter(F.col("op").isin("created", "deleted", "renamed")).select("volume", "usn", "op", "frn", "parent_frn", "name", "is_dir")
    ev = ev.join(ids, ["volume", "frn"], "left").join(ids.select("volume", F.col("frn").alias("parent_frn"), F.col("record").alias("parent_record")), ["volume", "parent_frn"], "left")
    ev = written(ev.withColumn("pk", F.when(F.col("op") != "deleted", "frn")).withColumn("pv", F.col("parent_frn")), "events")
    while True:
        rows = written(_own(ev), "folded")
        new = written(_parents(rows.select(*ev.columns, "version")).select(*ev.columns), "events")
        old = ev.select("volume", "usn", F.struct("pk", "pv").alias("__old"))
        moved = new.filter("op <> 'deleted'").join(old, ["volume", "usn"]).filter(~F.struct("pk", "pv").eqNullSafe(F.col("__old"))).limit(1).count()
        ev = new
        if not moved:
            break
    tombstones = rows.filter("record is not null and op <> 'created'").select("volume", "record").distinct()
    end = rows.groupBy("volume", "frn").agg(F.max_by(F.coalesce("version", F.lit(-1)), "usn").alias("__end"))
    made = ranked(rows.filter("makes"), ["usn"], "idx")
    meta = catalog.select("volume", "record", F.col("is_dir").alias("__d"), F.col("mtime").alias("__m"), (F.col("own_kib") * 1024).alias("__b"), F.col("size_exact").alias("__e"))
    made = made.join(end, ["volume", "frn"]).join(meta, ["volume", "record"], "left")
    base = F.col("origin.base")
    made = made.select(
        "volume", "idx", "frn", "usn", "name", F.col("pk").alias("parent_kind"), "pv",
        F.when(base, F.col("__m")).otherwise(F.lit(0)).cast("long").alias("mtime"),
        F.when(base, F.col("__d")).otherwise(F.col("origin.d")).alias("is_dir"),
        F.when(base, F.col("__b")).otherwise(F.lit(0)).cast("long").alias("size_bytes"),
        (base & F.col("__e")).alias("size_exact"), (F.col("__end") == F.col("usn")).alias("live"),
    )
    made = written(made, "versions")
    index = made.select("volume", F.col("usn").alias("pv"), F.lit("delta").alias("parent_kind"), F.col("idx").alias("__p"))
    added = made.join(index, ["volume", "pv", "parent_kind"], "left").withColumn("parent_idx", F.when(F.col("parent_kind") == "delta", F.col("__p")).otherwise(F.col("pv")))
    added = added.select(*[c.split()[0] for c in ADDED.split(", ")])
    return Overlay(written(tombstones, "tombstones"), written(added, "added"), rows.filter("lost").select("volume", "usn", "frn"))


def live_blobs(catalog: DataFrame, tombstones: DataFrame) -> DataFrame:
    """catalog plus `dead`, with dir_blob freed of the names of directories that are tombstoned.

    Only records below such a directory are rebuilt; without one, nothing is looked at record by record.
    """
    gone = if_small(tombstones.select("volume", "record", F.lit(True).alias("dead")))
    rows = catalog.join(gone, ["volume", "record"], "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    dirs = if_small(catalog.filter("is_dir").join(tombstones, ["volume", "record"], "left_semi").select("volume", F.col("record").alias("__a")))
    if not dirs.limit(1).count():
        return rows
    above = catalog.select("volume", "record", F.posexplode(F.slice("anc", 1, F.size("anc") - 1)).alias("__i", "__a"))
    touched = written(above.join(dirs, ["volume", "__a"], "left_semi").select("volume", "record").distinct(), "touched")
    names = rows.filter("is_dir").select("volume", F.col("record").alias("__a"), "lname", "dead")
    parts = above.join(touched, ["volume", "record"], "left_semi").join(names, ["volume", "__a"], "left").filter("not dead")
    blob = parts.groupBy("volume", "record").agg(F.array_sort(F.collect_list(F.struct("__i", "lname"))).alias("__parts"))
    blob = touched.join(blob, ["volume", "record"], "left").select("volume", "record", F.coalesce(F.array_join(F.transform("__parts", lambda x: x["lname"]), "\x00"), F.lit("")).alias("__blob"))
    return rows.join(blob, ["volume", "record"], "left").withColumn("dir_blob", F.coalesce("__blob", "dir_blob")).drop("__blob")


def view(catalog: DataFrame, overlay: Overlay) -> DataFrame:
    """Live base records and live additions as one view for searches; additions are numbered after the base.

    Sizes of base directories don't see the overlay. An addition inherits names from its chain of added directories up to
    the first that is dead or no directory; at a base parent, from it (if it lives) and from its live directories.
    """
    rows = written(live_blobs(catalog, overlay.tombstones), "blobs") if overlay.tombstones.limit(1).count() else catalog.withColumn("dead", F.lit(False))
    base = base_view(rows.filter("not dead"))
    start = overlay.added.select(
        "volume", "idx", F.when(F.col("parent_kind") == "delta", F.col("parent_idx")).alias("up"), F.when(F.col("parent_kind") == "base", F.col("parent_idx")).alias("bottom"),
        F.array("name").alias("names"), (F.col("live") & F.col("is_dir")).alias("ok"), F.when(F.col("live") & F.col("is_dir"), F.array(S.lname(F.col("name")))).otherwise(F.array().cast("array<string>")).alias("dirs"),
    )
    state = written(start, "chains")
    while state.filter("up is not null").limit(1).count():
        far = state.select("volume", F.col("idx").alias("up"), *[F.col(c).alias(f"__{c}") for c in ("up", "bottom", "names", "ok", "dirs")])
        step = state.filter("up is not null").join(far, ["volume", "up"]).select(
            "volume", "idx", F.col("__up").alias("up"), F.col("__bottom").alias("bottom"), F.concat("__names", "names").alias("names"), (F.col("ok") & F.col("__ok")).alias("ok"),
            F.when(F.col("ok"), F.concat("dirs", "__dirs")).otherwise(F.col("dirs")).alias("dirs"),
        )
        state = written(state.filter("up is null").unionByName(step), "chains")
    parent = state.select("volume", F.col("idx").alias("parent_idx"), F.lit("delta").alias("parent_kind"), F.col("ok").alias("__pok"), F.col("dirs").alias("__pdirs"))
    new = overlay.added.filter("live").join(state.select("volume", "idx", "bottom", "names"), ["volume", "idx"]).join(parent, ["volume", "parent_kind", "parent_idx"], "left")
    below = rows.select("volume", F.col("record").alias("bottom"), F.col("path").alias("__path"), F.concat_ws("\x00", F.when(~F.col("dead"), F.col("lname")), "dir_blob").alias("__blob"))
    new = new.join(below, ["volume", "bottom"], "left").join(if_small(catalog.groupBy("volume").agg(F.count(F.lit(1)).alias("__n"))), "volume", "left")
    inherits = (F.col("parent_kind") == "base") | F.col("__pok")
    blob = F.concat_ws("\x00", F.array_join("__pdirs", "\x00"), F.when(inherits, F.col("__blob")))
    kib = S.kib(F.col("size_bytes"))
    new = new.select(
        "volume", (F.coalesce("__n", F.lit(0)) + F.col("idx")).alias("record"), "name", S.lname(F.col("name")).alias("lname"), "is_dir", "mtime", kib.alias("eff_kib"), F.col("size_bytes").alias("size"),
        "size_exact", F.coalesce(blob, F.lit("")).alias("dir_blob"), F.concat_ws(SEPARATOR, "__path", F.array_join("names", SEPARATOR)).alias("path"),
    )
    return base.unionByName(new)


def compacted(catalog: DataFrame, overlay: Overlay, follow_frn: bool = False) -> DataFrame:
    """Canonical records of the view, to build the next catalog from. Ties of names keep base records first.

    A record whose parent version is dead becomes a root; follow_frn=True lets it follow the parent's id instead.
    """
    n = if_small(catalog.groupBy("volume").agg(F.count(F.lit(1)).alias("__n")))
    tomb = overlay.tombstones.withColumn("__dead", F.lit(True))
    named = catalog.select("volume", F.col("record").alias("parent"), F.col("frn").alias("parent_frn"))
    named = named.join(tomb.select("volume", F.col("record").alias("parent"), "__dead"), ["volume", "parent"], "left")
    alive = F.lit(True) if follow_frn else F.col("__dead").isNull()
    base_parent = named.select("volume", "parent", F.when(alive, F.col("parent_frn")).alias("parent_frn"))
    base = catalog.join(overlay.tombstones, ["volume", "record"], "left_anti").join(base_parent, ["volume", "parent"], "left")
    base = base.select("volume", F.col("record").alias("ord"), "frn", "parent_frn", "name", "is_dir", "mtime", (F.col("own_kib") * 1024).alias("size_bytes"), F.col("own_exact").alias("size_exact"))
    delta_parent = overlay.added.select("volume", F.col("idx").alias("parent_idx"), F.lit("delta").alias("parent_kind"), F.when(F.col("live") | F.lit(follow_frn), F.col("frn")).alias("parent_frn"))
    refs = delta_parent.unionByName(base_parent.select("volume", F.col("parent").alias("parent_idx"), F.lit("base").alias("parent_kind"), "parent_frn"))
    new = overlay.added.filter("live").join(refs, ["volume", "parent_kind", "parent_idx"], "left").join(n, "volume", "left")
    new = new.select("volume", (F.coalesce("__n", F.lit(0)) + F.col("idx")).alias("ord"), "frn", "parent_frn", "name", "is_dir", "mtime", "size_bytes", "size_exact")
    return base.unionByName(new)


def exceeds_threshold(n_events: int, n_base: int) -> bool:
    """More events than 5 % of the base: compact (or, on resuming, index anew)."""
    return n_events * 20 > n_base
