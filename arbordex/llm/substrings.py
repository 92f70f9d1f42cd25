"""Removal of long repeated substrings by merging shard Burrows-Wheeler transforms (operator 4).

A byte is removed if a string of `least` bytes covers it that starts at another place too, in any document. Looking at
every start of a large corpus at once is too much, so starts are first dealt out by content, without loss:

1. Anchors are places whose k-gram hash is the least in some window of W places. They follow from the text around
   them alone, and each string of `least` bytes holds one with `margin` bytes on either side. The first such anchor
   owns the string. Starts owned by one anchor are a chunk; the anchor's class is the hash of its surroundings.
2. Equal strings have owners of one class at one distance. A class seen once has no repeats. A class with one chunk that
   is seen several times has nothing to tell apart: the chunk is repeated as a whole. All other classes are merged.
3. There, every start is a string of BLOCKS symbols (names of its blocks of bytes) and an end mark; a chunk comes once and
   weighs as many as it is seen. Strings are dealt to shards of bounded size, each shard's Burrows-Wheeler transform is
   built by itself, and all are merged at once by refining their interleave: pass i orders the merged rotations by their
   first i symbols, by nothing but a stable distribution of the transforms' symbols. Where neighbours part first in pass i,
   their common prefix is i - 1 symbols; places whose common prefix is a whole string make an interval, and a string is
   repeated if its interval weighs more than one. No suffix is sorted again across shards.

A class of very many chunks is cut into parts of PART_CHUNKS, each merged by itself; the strings of a part's intervals then
meet those of the other parts with their weights. Strings are compared by 62-bit hashes in a prime field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm import _hashing as H
from arbordex.llm._common import if_small, partitions, release, small_batches, table, written

U64 = np.uint64
LEAST = 400
BLOCKS = 4
SHARD_STRINGS = 4096
MERGE_STRINGS = 16_000
PART_CHUNKS = 1024


class Layout:
    """k-gram length, window and margin for strings of `least` bytes."""

    def __init__(self, least: int) -> None:
        if least < 16:
            raise ValueError("least must be 16 or more")
        self.least = least
        self.k = max(4, min(32, least // 8))
        self.window = least // 4
        self.margin = (least - self.k - self.window) // 2


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def chunks(column: pa.Array, lay: Layout) -> tuple[np.ndarray, ...]:
    """Every chunk of every text: (document, class, chunk hash, first start, number of starts), by place.

    Starts count from the beginning of the column's bytes; also returns the bytes' offsets by document.
    """
    raw, offsets = H.text_bytes(column)
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < lay.least:
        return none, none.astype(U64), none.astype(U64), none, none, offsets
    h = H.prefix_hash(raw)
    at = np.arange(n - lay.k + 1)
    grams = H.span_hash(h, at, at + lay.k)
    low = _sliding(grams, lay.window, np.minimum)
    pad = np.zeros(lay.window - 1, U64)
    anchors = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), lay.window, np.maximum)[: len(grams)] == grams)
    start, end = anchors - lay.margin, anchors + lay.k + lay.margin
    inside = (start >= 0) & (end <= n)
    start, end = start[inside], end[inside]
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = end <= offsets[doc + 1]
    start, end, doc = start[inside], end[inside], doc[inside]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = doc[1:] != doc[:-1]
    first = np.where(new, offsets[doc], np.concatenate(([0], start[:-1] + 1))[: len(start)])
    last = np.minimum(start, offsets[doc + 1] - lay.least)
    own = last >= first
    start, end, doc, first, last = start[own], end[own], doc[own], first[own], last[own]
    kind = H.span_hash(h, start, end)
    chunk = H.mix(H.field_span(H.field_prefix(raw), first, last + lay.least) + (start - first).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return doc, kind, chunk, first, last - first + 1, offsets


# --- Burrows-Wheeler merge ---------------------------------------------------------------------------------------


def _transform(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Burrows-Wheeler transform, rotation numbers) of rows of symbols that end in 0; rotation r is row r // width."""
    n, width = strings.shape
    turned = np.stack([np.roll(strings, -j, axis=1) for j in range(width)], axis=1).reshape(n * width, width)
    order = np.lexsort(turned.T[::-1])
    return turned[order, -1], order


def merge_transforms(transforms: list[np.ndarray], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' rotations (shard by place), and common prefix of each place with the one before.

    Refines the interleave `passes` times; after pass i, rotations are in order of their first i symbols. A place that
    opens an interval first in pass i has i - 1 symbols in common with its neighbour (`passes` if none does: they are
    equal so far). The first place has none.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16 if len(transforms) < 1 << 16 else np.int64), [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    if symbols.max(initial=0) < 1 << 16:
        symbols = symbols.astype(np.uint16)  # distributed by counting
    interval = np.zeros(len(shard), dtype=np.int64)
    prefix = np.full(len(shard), passes, dtype=np.int64)
    merged = np.empty_like(symbols)
    for i in range(passes):
        merged[np.argsort(shard, kind="stable")] = symbols
        order = np.argsort(merged, kind="stable")
        shard, was, by = shard[order], interval[order], merged[order]
        parts = np.concatenate(([True], (by[1:] != by[:-1]) | (was[1:] != was[:-1])))
        prefix[parts & (prefix == passes)] = i  # intervals only split: a place that opens one stays where it is
        interval = np.cumsum(parts) - 1
    return shard, prefix


def intervals(symbols: np.ndarray, shard_strings: int = SHARD_STRINGS) -> np.ndarray:
    """For rows of symbols: the number of each row's interval of equal rows."""
    n, width = symbols.shape
    coded = pa.array(symbols.ravel()).dictionary_encode().indices.to_numpy(zero_copy_only=False)  # any order of symbols will do
    strings = np.concatenate((coded.reshape(n, width).astype(np.int64) + 1, np.zeros((n, 1), np.int64)), axis=1)
    parts = [_transform(strings[i : i + shard_strings]) for i in range(0, n, shard_strings)]
    shard, prefix = merge_transforms([t for t, _ in parts], width + 1)
    rotation = np.empty(len(shard), dtype=np.int64)
    rotation[np.argsort(shard, kind="stable")] = np.concatenate([order + i * shard_strings * (width + 1) for i, (_, order) in enumerate(parts)])
    whole = rotation % (width + 1) == 0
    number = np.cumsum(prefix < width) - 1  # neighbours with a whole string in common are one interval
    out = np.empty(n, dtype=np.int64)
    out[rotation[whole] // (width + 1)] = number[whole]
    return out


def repeated_strings(symbols: np.ndarray, weight: np.ndarray | None = None, shard_strings: int = SHARD_STRINGS) -> np.ndarray:
    """For rows of symbols that occur `weight` times each (once): which rows occur more than once in all."""
    if not len(symbols):
        return np.zeros(0, dtype=bool)
    at = intervals(symbols, shard_strings)
    return np.bincount(at, np.ones(len(at)) if weight is None else weight)[at] > 1


def _symbols(text: bytes | memoryview, starts: int, lay: Layout) -> np.ndarray:
    """Names of the blocks of the strings at 0 .. starts - 1; the last block ends where the string ends."""
    h = H.field_prefix(np.frombuffer(text, np.uint8))
    block = -(-lay.least // BLOCKS)
    at = np.arange(starts)
    return np.stack([H.field_span(h, at + o, at + o + block) for o in [*range(0, lay.least - block, block)][: BLOCKS - 1] + [lay.least - block]], axis=1)


# --- stages ------------------------------------------------------------------------------------------------------


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lay = Layout(least)
    for whole in batches:
        for b in H.slices(whole, "__text"):
            doc, kind, chunk, _, _, _ = chunks(b["__text"], lay)
            mark = H.mix(chunk + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
            _, one, n = np.unique(mark, return_index=True, return_counts=True)  # a chunk once a document
            yield pa.RecordBatch.from_arrays([b["__id"].take(pa.array(doc[one])), b["__h"].take(pa.array(doc[one])), _signed(kind[one]), _signed(chunk[one]), pa.array(n)], ["__id", "__h", "kind", "chunk", "n"])


def _chunk_rows(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of wanted chunks: rows with text and wanted (array of kind, chunk, n, parts)."""
    lay = Layout(least)
    for whole in batches:
        for b in H.slices(whole, "__text"):
            doc, kind, chunk, first, starts, offsets = chunks(b["__text"], lay)
            raw, _ = H.text_bytes(b["__text"])
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            rows: list[tuple] = []
            for d, wanted in enumerate(b["wanted"].to_pylist()):
                i, j = cut[d], cut[d + 1]
                place = {(k, c): i + p for p, (k, c) in reversed(list(enumerate(zip(kind[i:j].view(np.int64).tolist(), chunk[i:j].view(np.int64).tolist(), strict=True))))}
                for w in wanted:
                    p = place[w["kind"], w["chunk"]]
                    rows.append((w["kind"], w["chunk"] % w["parts"], w["parts"], w["chunk"], w["n"], int(starts[p]), raw[first[p] : first[p] + starts[p] - 1 + least].tobytes()))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:6]), pa.array(c[6], pa.binary())], ["kind", "part", "parts", "chunk", "n", "starts", "bytes"])


_RESOLVED = "kind long, chunk long, mask binary, string binary, weight long, places array<struct<chunk: bigint, at: bigint>>"
_PLACES = pa.list_(pa.struct([("chunk", pa.int64()), ("at", pa.int64())]))


def _resolved(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (kind, part) to (kind, chunk, mask) of those with a repeated start; classes are merged some at a time.

    Of a class with other parts, the strings go on instead: (kind, string, weight, places), once each.
    """
    lay = Layout(least)
    held: list[tuple] = []
    strings = 0

    def out() -> Iterator[pa.RecordBatch]:
        symbols = np.concatenate([_symbols(t, n, lay) for *_, n, t in held])
        cuts = np.concatenate(([0], np.cumsum([n for *_, n, _ in held])))
        weight = np.repeat([w for *_, w, _, _ in held], np.diff(cuts))
        at = intervals(symbols)  # equal strings are of one class
        rows: list[tuple] = []
        total = np.bincount(at, weight).astype(np.int64)
        found = total[at] > 1
        if held[0][2] == 1:
            rows = [(k, c, np.packbits(found[i:j]).tobytes(), None, None, None) for (k, _, _, c, *_), i, j in zip(held, cuts[:-1], cuts[1:], strict=True) if found[i:j].any()]
        else:
            chunk = np.repeat([c for _, _, _, c, *_ in held], np.diff(cuts))
            place = np.arange(len(at)) - np.repeat(cuts[:-1], np.diff(cuts))
            order = np.argsort(at, kind="stable")
            ends = np.append(np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1]))), len(order))
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                some = order[i:j]
                rows.append((held[0][0], None, None, symbols[some[0]].tobytes(), int(total[at[some[0]]]), [{"chunk": c, "at": x} for c, x in zip(chunk[some].tolist(), place[some].tolist(), strict=True)]))
        if rows:
            c = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), _PLACES]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["kind", "chunk", "mask", "string", "weight", "places"])

    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in ("kind", "part", "parts", "chunk", "n", "starts", "bytes")), strict=True):
            if held and held[-1][:2] != row[:2] and (strings + row[5] > MERGE_STRINGS or row[2] > 1 or held[-1][2] > 1):
                yield from out()
                held, strings = [], 0
            held.append(row)
            strings += row[5]
    if held:
        yield from out()


def _mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks = []
        for places in b["places"].to_pylist():
            m = np.zeros(max(places) + 1, dtype=bool)
            m[places] = True
            masks.append(np.packbits(m).tobytes())
        yield pa.RecordBatch.from_arrays([b["kind"], b["chunk"], pa.array(masks, pa.binary())], ["kind", "chunk", "mask"])


def _cut(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their marked chunks to (id, n_bytes, kept, spans)."""
    lay = Layout(least)
    for whole in batches:
        for b in H.slices(whole, "__text"):
            raw, offsets = H.text_bytes(b["__text"])
            marks = b["marks"].to_pylist()
            kept: list[bytes] = []
            spans: list[list[dict]] = []
            doc = kind = chunk = first = starts = None
            if any(marks):
                doc, kind, chunk, first, starts, _ = chunks(b["__text"], lay)
                cuts = np.searchsorted(doc, np.arange(b.num_rows + 1))
                kind, chunk = kind.view(np.int64), chunk.view(np.int64)
            for d, mark in enumerate(marks):
                base, n = int(offsets[d]), int(offsets[d + 1] - offsets[d])
                text = raw[base : base + n]
                if not mark:
                    kept.append(text.tobytes())
                    spans.append([])
                    continue
                cover = np.zeros(n + 1, dtype=np.int64)
                by = {(m["kind"], m["chunk"]): m["mask"] for m in mark}
                for p in range(cuts[d], cuts[d + 1]):
                    key = (int(kind[p]), int(chunk[p]))
                    if key in by:
                        f, s = int(first[p]) - base, int(starts[p])
                        if by[key] is None:
                            cover[f] += 1
                            cover[f + s - 1 + least] -= 1
                        else:
                            where = np.flatnonzero(np.unpackbits(np.frombuffer(by[key], np.uint8))[:s])  # may be shorter
                            np.add.at(cover, f + where, 1)
                            np.add.at(cover, f + where + least, -1)
                gone = np.cumsum(cover[:n]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                kept.append(text[~gone].tobytes())
                spans.append([{"start": a, "end": z} for a, z in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [b["__id"], pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["__id", "n_bytes", "kept", "spans"]
            )


def remove_repeats(docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, kept (the bytes left) and spans (removed runs: start, end in bytes).

    Texts are their UTF-8 bytes; null and empty ones have none. Matches never cross documents; the same document counts,
    and so do overlaps. Rows that repeat an id and its text are documents of their own (and repeat one another). Null ids
    are as good as others. Extra columns are not read; an empty table gives no rows.
    """
    spark = small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("__id"), F.xxhash64(docs[text_col]).alias("__h"), docs[text_col].alias("__text"))
    anchors = rows.filter(F.octet_length("__text") >= least).mapInArrow(lambda it: _anchor_rows(least, it), f"__id {kind}, __h long, kind long, chunk long, n long")
    shared = anchors.select("kind", "n").groupBy("kind").agg(F.sum("n").alias("__n")).filter("__n > 1").select("kind")
    found = written(anchors.join(shared, "kind", "left_semi"), "anchors")
    variants = found.groupBy("kind", "chunk").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("__id").isNull(), "__id", "__h")).alias("rep"))
    variants = written(variants, "chunks")
    classes = variants.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / PART_CHUNKS).cast("long").alias("parts"), F.count(F.lit(1)).alias("chunks"))
    classes = variants.join(classes, "kind")
    wanted = classes.filter("chunks > 1").groupBy(F.col("rep.__id").alias("__wid"), F.col("rep.__h").alias("__wh")).agg(F.collect_list(F.struct("kind", "chunk", "n", "parts")).alias("wanted"))
    wanted = written(wanted, "wanted")  # a document's list is bounded by its length

    def of(keys: DataFrame) -> tuple:
        return rows["__id"].eqNullSafe(keys["__wid"]) & (rows["__h"] == keys["__wh"])

    ids = if_small(wanted.select("__wid", "__wh"))
    texts = rows.join(ids, of(ids), "left_semi").dropDuplicates(["__id", "__h"])
    texts = texts.join(wanted, texts["__id"].eqNullSafe(wanted["__wid"]) & (texts["__h"] == wanted["__wh"])).select("__text", "wanted")
    pieces = texts.mapInArrow(lambda it: _chunk_rows(least, it), "kind long, part long, parts long, chunk long, n long, starts long, bytes binary")
    pieces = pieces.repartition(partitions(spark), "kind", "part").sortWithinPartitions("kind", "part")
    resolved = written(pieces.mapInArrow(lambda it: _resolved(least, it), _RESOLVED), "resolved")
    strings = resolved.filter("string is not null")
    again = strings.groupBy("kind", "string").agg(F.sum("weight").alias("__all")).filter("__all > 1").select("kind", "string")
    places = strings.join(again, ["kind", "string"]).select("kind", F.explode("places").alias("place")).groupBy("kind", "place.chunk").agg(F.collect_list("place.at").alias("places"))  # at most a window's
    partly = places.select("kind", "chunk", "places").mapInArrow(_mask_rows, "kind long, chunk long, mask binary")
    merged = resolved.filter("string is null").select("kind", "chunk", "mask")
    wholly = classes.filter("chunks = 1").select("kind", "chunk", F.lit(None).cast("binary").alias("mask"))
    marks = wholly.unionByName(merged).unionByName(partly)
    marked = found.join(marks, ["kind", "chunk"]).groupBy(F.col("__id").alias("__wid"), F.col("__h").alias("__wh")).agg(F.collect_set(F.struct("kind", "chunk", "mask")).alias("marks"))
    marked = written(marked, "marks")
    release(found, variants, wanted, resolved)
    ids = if_small(marked.select("__wid", "__wh"))
    touched = rows.join(ids, of(ids), "left_semi")
    touched = touched.join(marked, touched["__id"].eqNullSafe(marked["__wid"]) & (touched["__h"] == marked["__wh"])).select("__id", "__text", "marks")
    rest = rows.join(ids, of(ids), "left_anti").select("__id", "__text", F.array().cast(marked.schema["marks"].dataType).alias("marks"))
    out = f"__id {kind}, n_bytes long, kept binary, spans array<struct<start: bigint, end: bigint>>"
    return touched.unionByName(rest).mapInArrow(lambda it: _cut(least, it), out).withColumnRenamed("__id", id_col)


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = {
    "op4_repeated_substrings": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
f AS (SELECT r, n, unnest(range(0, n - 399, 400)) AS f, h FROM d WHERE n >= 400),
p AS (SELECT r, f, substr(h, 2 * f + 1, 1598) AS h, least(f + 400, n - 399) AS z FROM f),
q AS (SELECT r, unnest(range(f, z)) AS i, f, h FROM p),
k AS (SELECT r, i, md5(substr(h, 2 * (i - f) + 1, 800)) AS k FROM q),
twice AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM k SEMI JOIN twice USING (k)),
run AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM m),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM run GROUP BY r, run),
cut AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT cut.r, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM cut JOIN d USING (r) GROUP BY cut.r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
}
QUERIES = {"op4_repeated_substrings": op4_repeated_substrings}
