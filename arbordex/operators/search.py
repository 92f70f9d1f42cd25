"""Predicates, sort keys and bounded top-k over catalogs and overlay views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordex.functions import regex as R
from arbordex.functions import scalars as S
from arbordex.plans.qlang import MAX_TERMS, Filter, Query, ascii_lower

MAX_LIMIT = 100_000
_LENGTH_BITS = 24


def term_matches(term: str) -> tuple[Column, Column]:
    """(own name has the term, own name or a directory above has it)."""
    t = ascii_lower(term)
    if "\x00" in t:
        return F.lit(False), F.lit(False)
    own = F.contains(F.col("lname"), F.lit(t))
    return own, own | F.contains(F.col("dir_blob"), F.lit(t))


def filter_column(f: Filter) -> Column:
    parts = [F.lit(True)]
    size = F.col("eff_kib") * 1024
    if f.is_dir is not None:
        parts.append(F.col("is_dir") == f.is_dir)
    if f.extensions:
        parts.append(~F.col("is_dir") & F.coalesce(S.extension(F.col("lname")).isin(*f.extensions), F.lit(False)))
    if f.min_size is not None or f.max_size is not None:
        parts.append(F.col("size_exact"))
    bounds = [(f.min_size, size.__ge__), (f.max_size, size.__le__), (f.min_mtime, F.col("mtime").__ge__), (f.max_mtime, F.col("mtime").__le__)]
    parts += [op(F.lit(min(v, (1 << 63) - 1))) for v, op in bounds if v is not None]
    return reduce(lambda a, b: a & b, parts)


def compile_query(q: Query) -> tuple[Column, Column]:
    """(condition, match quality) over view columns; invalid patterns and term lists match nothing."""
    name, text = F.col("lname"), F.lit(ascii_lower(q.text))
    quality = F.when(name == text, 0).when(F.startswith(name, text), 1).otherwise(2)
    if q.kind == "prefix":
        return F.startswith(name, text), quality
    if q.kind == "substring":
        return F.contains(name, text), quality
    if q.kind == "regex":
        pattern = R.java(q.text)
        if pattern is None:
            return F.lit(False), F.lit(2)
        needed = [reduce(lambda a, b: a | b, [F.contains(name, F.lit(x)) for x in sorted(clause)]) for clause in R.required_literals(q.text)]
        return reduce(lambda a, b: a & b, [*needed, F.col("name").rlike(pattern)]), F.lit(2)
    if not q.terms or len(q.terms) > MAX_TERMS:
        return F.lit(False), F.lit(0)
    own, anywhere = zip(*map(term_matches, q.terms), strict=True)
    found = reduce(lambda a, b: a & b, anywhere) & filter_column(q.filter)
    return found, F.lit(len(q.terms)) - reduce(lambda a, b: a + b, [c.cast("int") for c in own])


def rank_bits(order: str, quality: Column) -> Column:
    """The sort key of an order, smaller is better; ties go to the smaller record."""
    if order == "relevance":
        return quality.cast("long") * (1 << _LENGTH_BITS) + F.least(F.octet_length("name").cast("long"), F.lit((1 << _LENGTH_BITS) - 1))
    if order == "recent":
        return F.lit(S.U32_MAX) - F.col("mtime")
    if order == "largest":
        return F.lit(S.U32_MAX) - F.when(F.col("size_exact"), F.col("eff_kib")).otherwise(F.lit(0))
    raise ValueError(f"unknown order: {order!r}")


def base_view(catalog: DataFrame) -> DataFrame:
    """A catalog as a view: what searches read, with eff_kib (recursive for the key and the filter) and size."""
    size = F.when(F.col("is_dir"), F.col("rec_kib")).otherwise(F.col("own_kib")) * 1024
    return catalog.select("volume", "record", "name", "lname", "is_dir", "mtime", F.col("rec_kib").alias("eff_kib"), size.alias("size"), "size_exact", "dir_blob", "path")


def clamp(limit: int) -> int:
    return max(0, min(limit, MAX_LIMIT))


def hits(view: DataFrame, q: Query, order: str = "relevance", limit: int = 50, slots: dict[str, int] | None = None, with_paths: bool = False) -> DataFrame:
    """Ranked hits (slot, volume, record, rank_bits, size, mtime, is_dir, size_exact), best first; with path if asked for.

    Each volume's candidates are filtered before the bounded top-k; across volumes, ties of rank_bits go by slot, then
    record. slots: volume to slot (default: all 0). Paths come along in the same scan: only a partition's best rows hold one.
    """
    found, quality = compile_query(q)
    slot = F.lit(0)
    for volume, number in sorted((slots or {}).items()):
        slot = F.when(F.col("volume") == volume, number).otherwise(slot)
    keyed = view.filter(found).select(slot.cast("int").alias("slot"), "volume", "record", rank_bits(order, quality).alias("rank_bits"), "size", "mtime", "is_dir", "size_exact", *(["path"] if with_paths else []))
    return keyed.orderBy("rank_bits", "slot", "record").limit(clamp(limit))


def scan(view: DataFrame, q: Query, limit: int = 50, *, in_order: bool = True) -> DataFrame:
    """The first `limit` matches in the order of records (names), unranked: (volume, record, name).

    in_order=False takes any: each partition stops after `limit` matches, and no rows are sorted.
    """
    found = view.filter(compile_query(q)[0]).select("volume", "record", "name")
    return (found.orderBy("volume", "record") if in_order else found).limit(clamp(limit))


def materialise(view: DataFrame, found: DataFrame) -> DataFrame:
    """Hits with their paths, best first. Only hits (MAX_LIMIT rows at most) are broadcast."""
    paths = view.select(F.col("volume").alias("__v"), F.col("record").alias("__r"), "path")
    few = F.broadcast(found)
    joined = paths.join(few, (paths["__v"] == few["volume"]) & (paths["__r"] == few["record"])).drop("__v", "__r")
    return joined.orderBy("rank_bits", "slot", "record")


def search(view: DataFrame, q: Query, order: str = "relevance", limit: int = 50, slots: dict[str, int] | None = None) -> DataFrame:
    """Results (path, size, mtime, is_dir, size_exact) best first."""
    return hits(view, q, order, limit, slots, with_paths=True).select("path", "size", "mtime", "is_dir", "size_exact")


def match_mask(view: DataFrame, terms: list[str]) -> DataFrame:
    """(volume, record, mask): bit i set where the own name has term i."""
    bits = [F.when(term_matches(t)[0], 1 << i).otherwise(0) for i, t in enumerate(terms[:MAX_TERMS])]
    return view.select("volume", "record", reduce(lambda a, b: a + b, bits, F.lit(0)).cast("long").alias("mask"))
