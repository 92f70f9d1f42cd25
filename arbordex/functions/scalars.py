"""Scalar functions of the catalog as Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER26 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER26 = "abcdefghijklmnopqrstuvwxyz"
U32_MAX = 4294967295
#: Seconds between 1601 and 1970.
FILETIME_EPOCH = 11644473600
UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]


def lname(name: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(name, UPPER26, LOWER26)


def extension(lowered: Column) -> Column:
    """Text after the last dot of a lowered name; null without a dot ('foo.' gives '')."""
    return F.when(F.contains(lowered, F.lit(".")), F.element_at(F.split(lowered, "[.]", -1), -1))


def kib(size_bytes: Column) -> Column:
    """Bytes in KiB, rounded up, saturating at 2^32 - 1."""
    return F.least(F.shiftright(size_bytes, 10) + F.when(size_bytes.bitwiseAND(F.lit(1023)) > 0, F.lit(1)).otherwise(F.lit(0)), F.lit(U32_MAX)).cast("long")


def filetime_seconds(filetime: Column) -> Column:
    """100 ns ticks since 1601 to seconds since 1970, clamped to 0 .. 2^32 - 1; not positive: 0."""
    ticks = ((filetime - F.pmod(filetime, F.lit(10_000_000))).cast("decimal(20,0)") / F.lit(10_000_000)).cast("long")
    return F.when(filetime <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(ticks - FILETIME_EPOCH, F.lit(U32_MAX)))).cast("long")


def human_size(size: Column) -> Column:
    """Bytes with a binary unit: whole numbers from 10 on and where the fraction is under 0.05, else one decimal."""
    value, unit = size.cast("double"), F.lit(UNITS[0])
    for k, name in enumerate(UNITS[1:], 1):
        big = size >= F.lit(1 << 10 * k)
        value = F.when(big, size.cast("double") / float(1 << 10 * k)).otherwise(value)
        unit = F.when(big, F.lit(name)).otherwise(unit)
    whole = (value >= 10) | (value - F.floor(value) < 0.05)
    return F.when(size == 0, "0 B").otherwise(F.concat(F.when(whole, F.bround(value, 0).cast("long").cast("string")).otherwise(F.format_string("%.1f", F.bround(value, 1))), F.lit(" "), unit))


def display_size(size: Column, is_dir: Column, size_exact: Column) -> Column:
    """Exact sizes as they are, known parts of directories with a sign in front, unknown sizes as a dash."""
    return F.when(size_exact | (is_dir & (size > 0)), F.concat(F.when(size_exact, "").otherwise("≥"), human_size(size))).otherwise("—")


def display_path(path: Column, is_dir: Column, marker: str = "/") -> Column:
    return F.concat(path, F.when(is_dir, marker).otherwise(""))


def visible(text: Column) -> Column:
    """Control characters replaced by U+FFFD."""
    return F.regexp_replace(text, "\\p{Cc}", "\ufffd")


def fit_path(path: Column, width: int) -> Column:
    """A path in at most width characters: the tail after an ellipsis where it is longer."""
    if width <= 1:
        return F.when(F.char_length(path) <= width, path).otherwise("…"[:width])
    return F.when(F.char_length(path) <= width, path).otherwise(F.concat(F.lit("…"), F.substring(path, -(width - 1), width - 1)))


def local_time(mtime: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.date_format(F.timestamp_seconds(mtime), pattern)


def format_duration(micros: int) -> str:
    return f"{micros} µs" if micros < 1000 else f"{micros / 1000:.1f} ms"


def trigrams(lowered: Column) -> Column:
    """Distinct three-character pieces."""
    n = F.char_length(lowered)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(lowered, i, F.lit(3)))))
