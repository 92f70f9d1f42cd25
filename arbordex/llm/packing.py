"""Best-fit packing with Martello-Toth dominance reduction (operator 8).

Documents become token ids plus an end id; only those longer than the capacity are cut. Pieces of one length are alike
to the packer, so the instance is a histogram of at most `capacity` lengths, whatever the corpus. On it the driver
(1) fixes sequences that provably dominate all alternatives for the largest open piece: alone where nothing else fits,
with an exact partner, with the largest partner where no two others fit, or where no two others that fit add up to
more than it; then (2) packs the smaller instance left by best-fit decreasing, many equal sequences at a time. The plan is a
list of slots: pieces of one length with ranks from a to b go to sequences from s on, so many to each, from an offset on.

Pieces find their slot by their rank among pieces of their length. Ranks are counted within (length, salt) and offset by
the counts of the salts before, so a length that a third of all pieces share is ranked in many tasks. Tokenising happens once: pieces
with their ids are written to the shared folder, and only (id, piece, length) rows are shuffled after that.

Ids are the tokenizer's own, of each distinct pre-token once (see _tokens).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbordex.llm import _hashing as H
from arbordex.llm._common import if_small, partitions, small_batches, table, written
from arbordex.llm._tokens import Encoder

CAPACITY = 2048
END_ID = 0


@dataclass(frozen=True)
class Slot:
    """Pieces of `length` with first <= rank < first + count: `each` to a sequence, from `sequence` and `offset` on."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Slots for a histogram of piece lengths (1 to capacity)."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    slots: list[Slot] = []
    sequences = 0

    def put(length: int, n: int, each: int, sequence: int, offset: int) -> None:
        slots.append(Slot(length, used[length], n, each, sequence, offset))
        used[length] += n
        left[length] -= n

    def fix(j: int, k: int | None, n: int) -> None:
        nonlocal sequences
        put(j, n, 1, sequences, 0)
        if k is not None:
            put(k, n, 1, sequences, j)
        sequences += n

    changed = True
    while changed:
        changed = False
        open_ = sorted(n for n, c in left.items() if c)
        for j in reversed(list(open_)):
            while left[j]:
                room = capacity - j
                at = bisect_right(open_, room) - 1
                while at >= 0 and (not left[open_[at]] or (open_[at] == j and left[j] < 2)):
                    at -= 1
                if at < 0:  # nothing else fits
                    fix(j, None, left[j] if 2 * j > capacity else 1)
                    changed = True
                    continue
                k = open_[at]
                least = next(x for x in open_ if left[x])
                if not (k == room or 2 * least > room or (3 * least > room and _best_pair(open_, left, j, room) <= k)):
                    break
                fix(j, k, left[j] // 2 if j == k else min(left[j], left[k]))
                changed = True
            open_ = [x for x in open_ if left[x]]
    rooms: list[int] = []  # rising
    groups: dict[int, list[tuple[int, int]]] = {}  # room to (first sequence, count)

    def offer(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted((n for n, c in left.items() if c), reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, sequences
                n = -(-left[length] // (capacity // length))
                sequences += n
            each = room // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, each, first, capacity - room)
                offer(room - each * length, first, full)
            rest = min(left[length], each) if full < n else 0
            if rest:
                put(length, rest, rest, first + full, capacity - room)
                offer(room - rest * length, first + full, 1)
            offer(room, first + full + (rest > 0), n - full - (rest > 0))
    return slots


def _best_pair(open_: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The largest sum up to room of two pieces other than one of length j; 0 if there is none."""
    best, i, k = 0, 0, len(open_) - 1
    spare = lambda x: left[x] - (x == j)
    while i <= k:
        a, b = open_[i], open_[k]
        if not spare(a) or (i == k and spare(a) < 2):
            i += 1
        elif not spare(b) or a + b > room:
            k -= 1
        else:
            best = max(best, a + b)
            i += 1
    return best


# --- tokens ------------------------------------------------------------------------------------------------------


_WORKER: dict[int, Encoder] = {}


def _pieces(tokenizer_json: str, capacity: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark = zlib.crc32(tokenizer_json.encode())
    if mark not in _WORKER:
        _WORKER[mark] = Encoder(tokenizer_json)  # the worker's next task starts with this cache
    encoder = _WORKER[mark]
    for whole in batches:
        for b in H.slices(whole, "__text"):
            ids, offsets = encoder.encode(b["__text"], END_ID)
            data = memoryview(ids.astype("<u4").tobytes())
            row, piece, start, length, crc, cut = [], [], [], [], [], []
            for d, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for p, a in enumerate(range(i, j, capacity)):
                    z = min(a + capacity, j)
                    row.append(d)
                    piece.append(p)
                    start.append(a - i)
                    length.append(z - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * z]))
                    if with_ids:
                        cut.append(bytes(data[4 * a : 4 * z]))
            columns = [b["__id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["__id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())], [*names, "ids"]) if with_ids else pa.RecordBatch.from_arrays(columns, names)


def tokenised(docs: DataFrame, tokenizer_json: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: __id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    return rows.mapInArrow(lambda it: _pieces(tokenizer_json, capacity, with_ids, it), f"__id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of every piece.

    Null and empty texts are one piece of the end id. Null ids and repeated rows are documents of their own. An empty
    table gives no rows. Other columns are not read.
    """
    spark = small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    pieces = written(tokenised(docs, tokenizer_json, capacity=capacity, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    salts = max(16, partitions(spark))
    content = ["__id", "piece", "start", "length", "ids_crc32"]
    rows = pieces.select(*content, *(["ids"] if with_ids else []), F.pmod(F.xxhash64("__id", "piece", "ids_crc32"), F.lit(salts)).cast("int").alias("__salt"))
    cells = rows.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # capacity rows at most
    slots = [(s.length, s.first, s.count, s.each, s.sequence, s.offset) for s in plan(histogram, capacity)]
    slots = if_small(spark.createDataFrame(slots, "length long, __first long, __count long, __each long, __seq long, __off long"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # A (length, salt) cell goes to one window group; its offset joins it there, on the same keys.
    numbered = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*[c for c in content if c != "length"])) - 1)
    ranked = numbered.join(cells, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    on = (ranked["length"] == slots["length"]) & (ranked["__rank"] >= slots["__first"]) & (ranked["__rank"] < slots["__first"] + slots["__count"])
    at = F.col("__rank") - F.col("__first")
    return ranked.join(slots, on).select(
        F.col("__id").alias(id_col),
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("__seq") + F.floor(at / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__off") + at % F.col("__each") * ranked["length"]).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (little-endian unsigned 32-bit) of every sequence; packed must carry its ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most `capacity` pieces
    joined = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length")).select("sequence_id", "length", joined.alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


ORACLE: dict[str, str] = {}
QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
