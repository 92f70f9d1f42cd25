"""From raw volume listings and journal rows to canonical records and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbordex.functions import scalars as S

# Journal reason bits and the source-info bit of auxiliary data. Fixed values.
REASON_CREATE = 0x00000100
REASON_DELETE = 0x00000200
REASON_RENAME_OLD = 0x00001000
REASON_RENAME_NEW = 0x00002000
SOURCE_AUXILIARY = 0x00000002
STRUCTURAL = REASON_CREATE | REASON_DELETE | REASON_RENAME_OLD | REASON_RENAME_NEW
#: Name spaces of a link: POSIX 0, Win32 1, DOS 2 (never shown), Win32 and DOS 3. Fixed values.
NS_DOS = 2
NS_WIN32 = (1, 3)


#: The op of an event row that stands for lost events.
OVERFLOW = "overflow"


class JournalChanged(ValueError):
    """The journal is another one than the cursor's: index anew."""


class JournalAgedOut(ValueError):
    """The journal no longer reaches back to the cursor: index anew."""


def pick_link(links: DataFrame) -> DataFrame:
    """One name per (volume, frn) of link rows (volume, frn, ord, ns, ...): Win32 before POSIX, DOS never, then the first."""
    rank = F.when(F.col("ns").isin(*NS_WIN32), 0).otherwise(1)
    best = Window.partitionBy("volume", "frn").orderBy(rank, "ord")
    return links.filter(F.col("ns") != NS_DOS).withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def merge_extensions(base: DataFrame, extensions: DataFrame) -> DataFrame:
    """base rows with size_bytes and mtime from their extension records (volume, base_frn, size_bytes, mtime) where given.

    Several extensions of one record are pre-aggregated (largest values), so no row multiplies.
    """
    e = extensions.groupBy("volume", F.col("base_frn").alias("frn")).agg(F.max("size_bytes").alias("__size"), F.max("mtime").alias("__mtime"))
    both = base.join(e, ["volume", "frn"], "left")
    size, mtime = F.coalesce("__size", "size_bytes"), F.coalesce("__mtime", "mtime")
    return both.withColumn("size_exact", F.col("size_exact") | F.col("__size").isNotNull()).withColumn("size_bytes", size).withColumn("mtime", mtime).select(*base.columns)


def unsized(listing: DataFrame) -> DataFrame:
    """Records of a reader that knows no sizes: 0 bytes, not exact."""
    return listing.withColumn("size_bytes", F.lit(0).cast("long")).withColumn("size_exact", F.lit(False))


def resolve_parents(records: DataFrame, root_frn: int) -> DataFrame:
    """records whose parent is missing, unknown or themselves hang under the volume's root (which keeps its own)."""
    known = records.select("volume", F.col("frn").alias("parent_frn"), F.lit(True).alias("__known"))
    orphan = F.col("__known").isNull() | (F.col("parent_frn") == F.col("frn"))
    parent = F.when(F.col("frn") == root_frn, F.col("parent_frn")).when(orphan, F.lit(root_frn).cast("long")).otherwise(F.col("parent_frn"))
    return records.join(known, ["volume", "parent_frn"], "left").withColumn("parent_frn", parent).select(*records.columns)


def decode_name(raw: Column) -> Column:
    """Little-endian UTF-16 bytes to text; surrogates without their other half become U+FFFD, an odd last byte is left out."""
    units = F.regexp_replace(F.regexp_replace(F.hex(raw), "(..)(..)", "$2$1 "), " ..$", " ")
    units = F.when(F.octet_length(raw) > 1, units).otherwise("")
    units = F.regexp_replace(units, "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    units = F.regexp_replace(units, "D[89AB].. (?!D[C-F])", "FFFD ")
    return F.when(raw.isNotNull(), F.decode(F.unhex(F.replace(units, F.lit(" "), F.lit(""))), "UTF-16BE"))


def link_counts(links: DataFrame) -> DataFrame:
    """(seen, short_names, emitted, records) of link rows: all, those never shown, those that may be, and distinct records."""
    shown = F.col("ns") != NS_DOS
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return links.agg(F.count(F.lit(1)).alias("seen"), count(~shown).alias("short_names"), count(shown).alias("emitted"), F.count_distinct(F.when(shown, F.struct("volume", "frn"))).alias("records"))


def from_filetimes(rows: DataFrame, col: str = "filetime") -> DataFrame:
    return rows.withColumn("mtime", S.filetime_seconds(F.col(col)))


def is_structural(reason: Column) -> Column:
    return reason.bitwiseAND(F.lit(STRUCTURAL)) != 0


def classify(journal: DataFrame) -> DataFrame:
    """journal rows (reason, source_info) with op and is_auxiliary: delete before create before rename, else modified."""
    has = lambda bit: F.col("reason").bitwiseAND(F.lit(bit)) != 0
    op = F.when(has(REASON_DELETE), "deleted").when(has(REASON_CREATE), "created").when(has(REASON_RENAME_NEW), "renamed").otherwise("modified")
    return journal.withColumn("op", op).withColumn("is_auxiliary", F.col("source_info").bitwiseAND(F.lit(SOURCE_AUXILIARY)) != 0)


def lost_data(events: DataFrame) -> DataFrame:
    """Rows by which a reader says that it lost events: what follows can't be folded, and a full index is needed."""
    return events.filter(F.col("op") == OVERFLOW)


def check_cursor(cursor: dict, journal: dict) -> None:
    """Raise unless events from cursor (volume_serial, journal_id, next_usn) on are all in journal (also first_usn)."""
    if any(cursor[k] != journal[k] for k in ("volume_serial", "journal_id")) or cursor["next_usn"] > journal["next_usn"]:
        raise JournalChanged(cursor)
    if cursor["next_usn"] < journal["first_usn"]:
        raise JournalAgedOut(cursor)


def replay(events: DataFrame, next_usn: int) -> DataFrame:
    """Events at and after the cursor; the comparison is pushed to the scan."""
    return events.filter(F.col("usn") >= next_usn)


def real_changes(events: DataFrame, own_names: list[str] | None = None, use_auxiliary: bool = True) -> DataFrame:
    """Events that change the tree, in no order: no modifications, no cursor rows, none of the engine's own writes.

    own_names: folded names of files that the engine writes; what is created or renamed to one makes its frn the
    engine's own, and its next deletion no change either.
    """
    own = S.lname(F.col("name")).isin(*[n.lower() for n in own_names or []]) if own_names else F.lit(False)
    named = F.col("op").isin("created", "renamed")
    hidden = F.col("is_auxiliary") & F.lit(use_auxiliary)
    mark = F.when(F.col("op") == "deleted", False).when(named & own & ~hidden, True)
    before = Window.partitionBy("volume", "frn").orderBy("usn").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)) if own_names else F.lit(False)
    rows = events.withColumn("__mine", mine)
    keep = ~hidden & ((named & ~F.coalesce(own, F.lit(False))) | ((F.col("op") == "deleted") & ~F.col("__mine")))
    return rows.filter(keep).drop("__mine")
