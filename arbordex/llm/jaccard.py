"""N-gram Jaccard join by parity sketches (operator 3).

A document is its set of distinct word shingles. Sets that are equal collapse to one node. For a pair with Jaccard
similarity of at least t, the symmetric difference d is at most (a + b) (1 - t) / (1 + t) for set sizes a and b, and
sizes differ by a factor of at most t; so sizes fall into bands (each 1 / t wide), a pair lies in one band or in two
neighbours, and the larger set's band bounds d by some dmax.

Candidates: shingles are dealt to more than dmax blocks by hash, and each block holds the XOR of its shingles' 64-bit
hashes. d shingles touch at most d blocks, so of any d + 1 blocks one agrees (pigeonhole). A set emits its need + 1 blocks
of the most shingles, where need bounds d: the order (shingles in the block, block number) is the same for all sets, so the
shorter reach of two partners holds a block that agrees and that the other emits too. Blocks of a single shingle, which
a license line shared by thousands fills alike, come last and are hardly ever emitted. A set with too few blocks goes on
to further seeds, as its partner does if it has the same trouble, and last to keys of empty blocks. A node gives its keys
for its own band and for the next, packed by ranges of keys.

Verification: parity sketches (the XOR of one bit per shingle, folded to one length for two sets) bound the symmetric
difference from below by their Hamming distance, and go to meet, not texts. First each holder of a key meets the key's
least holder only (no pairs); what the sketches leave is compared word by word, and components of verified links are
found. A group of near copies is one component by then and done. Only in keys whose holders still lie in several
components do sketches meet pair by pair, in blocks; holders that are linked with the least holder don't meet those that
are too far from it. Survivors are compared in rounds: first each node's FRESH[0] nearest, then more of those that still lie
in other components, until none is left; so a group gives about as many pairs as it has nodes, not as it has links, and
those that sketches take for links. Numbers of links are counted inside verified components, block
by block, by products of incidence matrices. The words themselves decide each link, not hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbordex.llm import _hashing as H
from arbordex.llm._common import if_small, partitions, release, small_batches, table, written
from arbordex.llm._graph import components

U64 = np.uint64
#: Nodes of a component in one block: at least (of a key's holders four times that), at most; and blocks of those in between.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 64, 1024, 16
#: Keys that a task holds before they are merged and handed on; a key with more holders than HOT there is handed on once.
FLUSH_KEYS = 1 << 19
HOT = 64
#: How many of a node's nearest partners are compared in each round; one more round takes all that are left.
FRESH = (1, 8, 64)
#: Pairs that a task holds before it keeps each node's nearest.
HELD_PAIRS = 1 << 18
_SEEDS = 6
#: Status of a key's holder against the key's least holder.
LINKED, NEAR, FAR, FARTHER = range(4)


class Bands:
    """Size bands for a similarity of num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low = np.array([1, 2], np.int64)

    def reach(self, n: int) -> None:
        """Let the bands cover sizes of n, and two bands more."""
        low = self.low.tolist()
        while low[-3 if len(low) > 2 else 0] <= n or len(low) < 4:
            low.append(max(low[-1] + 1, -(-low[-1] * self.den // self.num)))
        self.low = np.array(low, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        self.reach(int(np.max(n, initial=1)))
        return np.searchsorted(self.low, n, side="right") - 1

    def dmax(self, band: np.ndarray) -> np.ndarray:
        """The most that the sets of a pair can differ by if the larger one is of this band."""
        return self.most(2 * (self.low[band + 1] - 1))

    def most(self, both: np.ndarray) -> np.ndarray:
        return both * (self.den - self.num) // (self.den + self.num)


def keys(x: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets of sorted shingle hashes, for their bands and the next: (keys, sets), both rising by set."""
    size = np.diff(offsets)
    of = np.repeat(np.arange(len(size)), size)
    band = bands.of(np.maximum(size, 1))
    widest = size * bands.den // bands.num
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        scheme = band + step
        top = bands.low[scheme + 1] - 1
        dmax = bands.dmax(scheme)
        need = bands.most(size + np.minimum(widest, top))
        blocks = (dmax + 2 + dmax // 3).astype(U64)
        salt = scheme.astype(U64) * U64(0x9E3779B97F4A7C15)
        left = (size > 0) & (widest >= bands.low[scheme]) & (dmax > 0)  # others have no partner there, or equal sets only
        for seed in range(_SEEDS):
            if not left.any():
                break
            at = np.flatnonzero(left[of])
            y, d = x[at], of[at]
            if seed:
                y = H.mix(y + U64(seed))
            block = ((y >> U64(32)) * blocks[d]) >> U64(32)
            if seed:
                order = np.lexsort((block, d))
                y, d, block = y[order], d[order], block[order]
            cut = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (d[1:] != d[:-1]))))
            value = np.bitwise_xor.reduceat(H.mix(y ^ U64(0x5851F42D4C957F2D)), cut)
            count, d, block = np.diff(np.append(cut, len(y))), d[cut], block[cut]
            order = np.lexsort((block, -count, d))
            first = np.searchsorted(d, np.arange(len(size)))
            some = order[np.arange(len(d)) - first[d] <= need[d]]  # d[order] is d
            out.append((H.mix(value[some] + H.mix(block[some] + salt[d[some]] + U64(seed << 40))), d[some]))
            got = np.bincount(d, minlength=len(size))
            left &= got <= need
            if seed == _SEEDS - 1:
                for i in np.flatnonzero(left):
                    empty = np.setdiff1d(np.arange(int(blocks[i]), dtype=U64), block[d == i])
                    out.append((H.mix(H.mix(empty + salt[i] + U64(_SEEDS << 40)) ^ U64(0xE7037ED1A0B428DB)), np.full(len(empty), i)))
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    key, doc = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(doc, kind="stable")
    return key[order], doc[order]


def sketches(x: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of sets: (bytes, offsets). A sketch has a power of two of bits, at least 16 for each that may differ."""
    size = np.diff(offsets)
    least = 16 * bands.dmax(bands.of(np.maximum(size, 1)))
    bits = 1 << np.ceil(np.log2(np.maximum(least, 64))).astype(np.int64)
    cuts = np.concatenate(([0], np.cumsum(bits)))
    of = np.repeat(np.arange(len(size)), size)
    at = (H.mix(x) & (bits[of] - 1).astype(U64)).astype(np.int64) + cuts[of]
    odd = (np.bincount(at, minlength=int(cuts[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), cuts // 8


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch (or rows of them) of `size` bytes: the halves' XOR, again and again."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


# --- profiles and keys -------------------------------------------------------------------------------------------


def _signatures(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits for every set (two columns), 0 for empty ones."""
    out = np.zeros((len(offsets) - 1, 2), U64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        at = offsets[some]
        out[some, 0] = np.bitwise_xor.reduceat(H.mix(x), at)
        out[some, 1] = np.add.reduceat(H.mix(x + U64(77)), at)
    return out


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _profile(width: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = Bands(num, den)
    for whole in batches:
        for b in H.slices(whole, "__text"):
            x, offsets = H.shingles(b["__text"], width)
            sig = _signatures(x, offsets)
            yield pa.RecordBatch.from_arrays(
                [b["__id"], b["__h"], pa.array(np.diff(offsets)), _binary(sig.astype("<u8").view(np.uint8), np.arange(len(sig) + 1) * 16), pa.array(sig[:, 0].view(np.int64) if len(sig) else np.zeros(0, np.int64)), _binary(*sketches(x, offsets, bands))],
                ["__id", "__h", "n", "sig", "class", "sketch"],
            )


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted columns begin, and the end."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def _keyed(width: int, num: int, den: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of texts as (bucket, blob): 15 bytes a key (rest of the key, class, hot).

    A key with more than HOT holders in a flush goes on once, with its least holder; the others follow as
    (-1 - n, 24 bytes a holder: key, least holder, holder), dealt by holder. So a key that a third of all texts have
    reaches its bucket once a flush.
    """
    bands = Bands(num, den)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[int] = set()
    total = 0

    def flush() -> pa.RecordBatch:
        key, node = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        bucket = key >> U64(64 - bits)
        key = (bucket << U64(48)) | (key & U64((1 << 48) - 1))
        cuts = _runs(key)
        many = np.repeat(np.diff(cuts) > HOT, np.diff(cuts))
        least = np.zeros(len(key), dtype=bool)
        least[cuts[:-1]] = True
        stay = least | ~many
        data = np.empty((int(stay.sum()), 15), np.uint8)
        data[:, :6] = key[stay].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        data[:, 6:14] = node[stay].astype("<i8").view(np.uint8).reshape(-1, 8)
        data[:, 14] = many[stay]
        at = bucket[stay].astype(np.int32)
        ends = _runs(at)
        blobs = [data[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
        numbers = at[ends[:-1]].tolist()
        if not stay.all():
            lead = np.repeat(node[cuts[:-1]], np.diff(cuts))
            rest = np.stack([x[~stay].view(np.int64) for x in (key, lead, node)], axis=1)
            to = rest[:, 2] % (1 << bits)
            rest = rest[np.argsort(to, kind="stable")]
            ends = _runs(np.sort(to))
            blobs += [rest[i:j].astype("<i8").tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            numbers += (-1 - np.sort(to)[ends[:-1]]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    for whole in batches:
        for b in H.slices(whole, "__text"):
            x, offsets = H.shingles(b["__text"], width)
            if not len(x):
                continue
            sets = _signatures(x, offsets)[:, 0].view(np.int64)
            new = np.zeros(len(sets), dtype=bool)
            for i in np.flatnonzero(np.diff(offsets)).tolist():
                if (one := int(sets[i])) not in seen:
                    seen.add(one)
                    new[i] = True
            key, doc = keys(x, offsets, bands)
            mine = new[doc]
            if mine.any():
                held.append((key[mine], sets[doc[mine]]))
                total += int(mine.sum())
            if total > FLUSH_KEYS:
                yield flush()
                held, seen, total = [], set(), 0
    if held:
        yield flush()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by bucket to (key, lead, class, hot) of every holder of a key with several."""
    blobs: list[bytes] = []
    at = None

    def rows(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], ["key", "lead", "class", "hot"])

    def out() -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 15)
        key = np.zeros((len(data), 8), np.uint8)
        key[:, :6] = data[:, :6]
        key = key.view("<u8").ravel() | (U64(at) << U64(48))
        node, hot = np.ascontiguousarray(data[:, 6:14]).view("<i8").ravel(), data[:, 14] > 0
        order = np.lexsort((~hot, node, key))
        key, node, hot = key[order], node[order], hot[order]
        one = _runs(key, node)[:-1]  # a class is held once by each task that has it
        hot = np.logical_or.reduceat(hot, one)
        key, node = key[one], node[one]
        cuts = _runs(key)
        n = np.diff(cuts)
        some = np.repeat(n > 1, n) | hot
        lead = np.repeat(node[cuts[:-1]], n)
        yield from rows(key[some].view(np.int64), lead[some], node[some], hot[some])

    for batch in batches:
        for bucket, blob in zip(batch["bucket"].to_pylist(), batch["blob"].to_pylist(), strict=True):
            if bucket < 0:
                rest = np.frombuffer(blob, "<i8").reshape(-1, 3)
                yield from rows(rest[:, 0], rest[:, 1], rest[:, 2], np.zeros(len(rest), dtype=bool))
                continue
            if bucket != at and blobs:
                yield from out()
                blobs = []
            at = bucket
            blobs.append(blob)
    if blobs:
        yield from out()


# --- meeting sketches --------------------------------------------------------------------------------------------


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of sketches (of one length), which bound symmetric differences from below."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _screened(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with sizes and sketches to (lead, class, a, b, status); NEAR ones with may = true are to be compared."""
    bands = Bands(num, den)
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = (batch[c].to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        gap = np.empty(batch.num_rows, np.int64)
        left, right = batch["sa"], batch["sb"]
        wide = np.stack([np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in (left, right)], axis=1).astype(np.int64)
        whole = [np.frombuffer(c.buffers()[2], np.uint8) for c in (left, right)]
        begin = [np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c)].astype(np.int64) for c in (left, right)]
        for wa, wb in np.unique(wide, axis=0):
            at = np.flatnonzero((wide[:, 0] == wa) & (wide[:, 1] == wb))
            step = max(1, (1 << 24) // int(max(wa, wb)))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                pair = [fold(data[start[some][:, None] + np.arange(w)], int(min(wa, wb))) for data, start, w in zip(whole, begin, (wa, wb), strict=True)]
                gap[some] = _hamming(*pair)
        small, large = np.minimum(na, nb), np.maximum(na, nb)
        may = (gap <= bands.most(na + nb)) & (small * den >= large * num)
        most = bands.most(2 * (large * den // num + 1) * den // num)  # of any pair of the key
        status = np.where(gap > 4 * most, FARTHER, np.where(gap > 2 * most, FAR, NEAR))
        yield pa.RecordBatch.from_arrays([batch["lead"], batch["class"], batch["a"], batch["b"], pa.array(status.astype(np.int32)), pa.array(may)], ["lead", "class", "a", "b", "status", "may"])


def meet(node: np.ndarray, label: np.ndarray, status: np.ndarray, hot: bool, size: np.ndarray, sketch: list[bytes], side: np.ndarray, cross: bool, bands: Bands, most: int) -> tuple[np.ndarray, bool]:
    """Pairs of a key's holders (of two blocks of them, if cross) in different components that their sketches can't rule out.

    Rows of (node, partner, distance of the sketches): each holder's `most` nearest partners before it in order of size;
    and whether that left any out.
    """
    out: list[np.ndarray] = []
    less = False
    linked, far = status == LINKED, status >= (FARTHER if hot else FAR)
    order = np.lexsort((node, size))
    rows = {w: np.stack([fold(np.frombuffer(s, np.uint8), w) if len(s) >= w else np.zeros(w, np.uint8) for s in sketch]) for w in {len(s) for s in sketch}}
    length = np.array([len(s) for s in sketch])
    spread = _spread(node)
    for p, i in enumerate(order.tolist()):
        past = order[:p]
        past = past[np.searchsorted(size[past] * bands.den, size[i] * bands.num) :]  # sizes rise
        fit = label[past] != label[i]
        fit &= ~(linked[past] & linked[i]) & ~(linked[past] & far[i]) & ~(far[past] & linked[i])
        if cross:
            fit &= side[past] != side[i]
        past = past[fit]
        gap = np.empty(len(past), np.int64)
        for w in np.unique(length[past]).tolist():  # of smaller sets, so not longer
            some = length[past] == w
            gap[some] = _hamming(rows[w][past[some]], fold(np.frombuffer(sketch[i], np.uint8), w))
        near = gap <= bands.most(size[past] + size[i])
        if near.any():
            past, gap = past[near], gap[near]
            if len(past) > most:
                few = np.lexsort((node[past], spread[past], gap))[:most]
                past, gap, less = past[few], gap[few], True
            out.append(np.stack((np.full(len(past), node[i]), node[past], gap), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64), less


def nearest(pairs: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """Of rows (node, partner, distance), each once, the `most` nearest of each node; and whether that left any out."""
    order = np.lexsort((pairs[:, 1], _spread(pairs[:, 1]), pairs[:, 2], pairs[:, 0]))
    pairs = pairs[order][_runs(*pairs[order].T)[:-1]]
    starts = _runs(pairs[:, 0])
    rank = np.arange(len(pairs)) - np.repeat(starts[:-1], np.diff(starts))
    return pairs[rank < most], bool((rank >= most).any())


def _spread(node: np.ndarray) -> np.ndarray:
    """An order among equally near partners that is the same everywhere, so that many nodes choose the same one."""
    return (H.mix(node.view(U64)) >> U64(1)).view(np.int64)


_MET = "key long, bi int, bj int, node long, partner long, gap long, spread long"


def _met_again(num: int, den: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holders sorted by (key, bi, bj) to (node, partner, gap, spread) that may be linked: the `most` nearest of each node.

    Groups with pairs come too, without a node; a row without either says that there are more pairs.
    """
    bands = Bands(num, den)
    held: list[np.ndarray] = []
    groups: list[tuple[int, int, int]] = []
    less = False

    def out() -> pa.RecordBatch:
        pairs = np.concatenate(held)
        marks = [*groups, *[(None, None, None)] * less]
        at = [pa.array([*[None] * len(pairs), *(m[k] for m in marks)], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        own = [pa.array([*c.tolist(), *[None] * len(marks)], pa.int64()) for c in (*pairs.T, _spread(np.ascontiguousarray(pairs[:, 1])))]
        return pa.RecordBatch.from_arrays([*at, *own], ["key", "bi", "bj", "node", "partner", "gap", "spread"])

    for group in _groups(batches, ("key", "bi", "bj")):
        column = {c: np.array([r[c] for r in group]) for c in ("node", "label", "status", "n", "block")}
        if (column["label"] == column["label"][0]).all():
            continue
        pairs, cut = meet(column["node"], column["label"], column["status"], group[0]["split"], column["n"], [r["sketch"] for r in group], column["block"], group[0]["bi"] != group[0]["bj"], bands, most)
        if len(pairs):
            held.append(pairs)
            groups.append((group[0]["key"], group[0]["bi"], group[0]["bj"]))
            less |= cut
        if sum(map(len, held)) > HELD_PAIRS:
            found, cut = nearest(np.concatenate(held), most)
            held, less = [found], less | cut
            if len(found) > HELD_PAIRS // 2:
                yield out()
                held, groups = [], []
    if held:
        found, cut = nearest(np.concatenate(held), most)
        held, less = [found], less | cut
        yield out()


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[dict]]:
    held: list[dict] = []
    mark = None
    for batch in batches:
        for r in batch.to_pylist():
            at = tuple(r[n] for n in names)
            if at != mark and held:
                yield held
                held = []
            mark = at
            held.append(r)
    if held:
        yield held


# --- comparing words ---------------------------------------------------------------------------------------------


def _confirmed(width: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts to the links (a, b) among them."""
    unpacker = zstandard.ZstdDecompressor()
    for whole in batches:
        sizes = np.array([len(x) + len(y) for x, y in zip(whole["ta"].to_pylist(), whole["tb"].to_pylist(), strict=True)])
        cuts = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(sizes) >> 19)) + 1, [whole.num_rows])))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            b = whole.slice(i, j - i)
            number: dict[int, int] = {}
            texts: list[bytes] = []
            pairs = []
            for side, text in (("a", "ta"), ("b", "tb")):
                at = []
                for node, packed in zip(b[side].to_pylist(), b[text].to_pylist(), strict=True):
                    if node not in number:
                        number[node] = len(texts)
                        texts.append(unpacker.decompress(packed))
                    at.append(number[node])
                pairs.append(np.array(at, np.int64))
            names, offsets = H.exact_shingles(texts, width)
            n = np.diff(offsets)
            top = int(names.max(initial=0)) + 1
            held = np.repeat(np.arange(len(n)), n) * top + names
            each = np.repeat(np.arange(len(pairs[1])), n[pairs[1]])
            inside = np.arange(len(each)) - np.repeat(np.cumsum(n[pairs[1]]) - n[pairs[1]], n[pairs[1]])
            wanted = pairs[0][each] * top + names[offsets[pairs[1]][each] + inside]
            hit = held[np.minimum(np.searchsorted(held, wanted), max(len(held) - 1, 0))] == wanted if len(held) else np.zeros(0, bool)
            same = np.bincount(each[hit], minlength=len(pairs[1]))
            linked = same * den >= num * (n[pairs[0]] + n[pairs[1]] - same)
            yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(linked)), b["b"].filter(pa.array(linked))], ["a", "b"])


def count_links(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Sum of the weights of the sets that each set is linked with (of the other side only, if sides are given)."""
    n = np.array([len(s) for s in sets])
    of, name = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    values, name, seen = np.unique(name, return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1  # a shingle of one set meets nothing
    of, name = of[seen[name] > 1], shared[name[seen[name] > 1]]
    same = np.zeros((len(sets), len(sets)), np.int32)
    order = np.argsort(name, kind="stable")
    of, name = of[order], name[order]
    for low in range(0, int(name.max(initial=-1)) + 1, 4096):
        i, j = np.searchsorted(name, (low, low + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[of[i:j], name[i:j] - low] = 1
        same += (part @ part.T).astype(np.int32)
    same = same.astype(np.int64)
    linked = same * den >= num * (n[:, None] + n[None, :] - same)
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    return linked @ weight


def _counted(width: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members sorted by (label, bi, bj), with texts, to (node, n_links) within the block pair."""
    unpacker = zstandard.ZstdDecompressor()
    for group in _groups(batches, ("label", "bi", "bj")):
        group = list({r["node"]: r for r in group}.values())
        names, offsets = H.exact_shingles([unpacker.decompress(r["packed"]) for r in group], width)
        side = np.array([r["block"] for r in group]) if group[0]["bi"] != group[0]["bj"] else None
        found = count_links([names[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)], np.array([r["weight"] for r in group], np.int64), side, num, den)
        yield pa.RecordBatch.from_arrays([pa.array([r["node"] for r in group], pa.int64()), pa.array(found, pa.int64())], ["node", "n_links"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["node"], pa.array([packer.compress(t.encode()) for t in b["__text"].to_pylist()], pa.binary())], ["node", "packed"])


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) once more links (a, b) hold, with their nodes. Labels are linked, not nodes, and each two once."""
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    ends = written(ends, "ends")
    top = components(ends.filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    nodes = labels.select("node", "label").union(ends.select("a", "la")).union(ends.select("b", "lb")).distinct()
    found = nodes.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    found = written(found, "labels")
    release(ends, top)
    return found


def _in_blocks(df: DataFrame, group: str, by: str, least: int) -> DataFrame:
    """df with block, bi and bj: each group is cut into blocks by `by`, and a row goes to all pairs of its block."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    blocks = F.ceil(F.col("__n") / F.least(F.greatest(F.ceil(F.col("__n") / BLOCKS), F.lit(least)), F.lit(MOST_BLOCK))).cast("int")
    cut = df.join(sizes.select(group, blocks.alias("__blocks")), group).withColumn("block", F.pmod(F.xxhash64(by), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other")
    return cut.select("*", other).withColumns({"bi": F.least("block", "__other"), "bj": F.greatest("block", "__other")}).drop("__blocks", "__other")


# --- the join ----------------------------------------------------------------------------------------------------


def jaccard_groups(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, n_links, and __h (xxhash64 of the text).

    Words are runs outside ASCII white space, lower-cased in A-Z; shingles have `width` words (a shorter text is one
    shingle). Rows are linked if den * intersection >= num * union. component_id: the smallest id reachable by links
    (null ids don't count; null if there are none else). n_links: other rows that a row is linked with. Null, empty
    and blank texts have no shingle, no link and their own id. Repeated rows are linked with each other. Extra columns
    are not read; an empty table gives no rows.
    """
    return _grouped(docs, width, num, den, id_col, text_col, True).drop("__c")


def _grouped(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, counted: bool) -> DataFrame:
    """jaccard_groups() with __c, the verified component's own key (ids may be null or repeat; null without shingles)."""
    spark = small_batches(docs.sparkSession)
    n_parts = partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("__id"), F.xxhash64(docs[text_col]).alias("__h"), docs[text_col].alias("__text"))
    profile = rows.mapInArrow(lambda it: _profile(width, num, den, it), f"__id {kind}, __h long, n long, sig binary, class long, sketch binary")
    profile = written(profile.withColumn("__row", F.monotonically_increasing_id()), "profiles")  # fixed once it is written
    some = profile.filter("n > 0")
    runs = max(64, n_parts)
    run = F.pmod(F.xxhash64("__row"), F.lit(runs)).cast("int").alias("__run")
    first = some.groupBy(run, "sig").agg(F.min("__row").alias("node"), F.min("class").alias("class"), F.count(F.lit(1)).alias("weight"), F.min("__id").alias("least"))
    classes = written(first.groupBy("sig").agg(F.min("node").alias("node"), F.min("class").alias("class"), F.sum("weight").alias("weight"), F.min("least").alias("least")), "classes")
    # Keys that several classes hold.
    bits = max(10, (16 * n_parts).bit_length())
    blobs = rows.select("__text").mapInArrow(lambda it: _keyed(width, num, den, bits, it), "bucket int, blob binary")
    held = blobs.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_met, "key long, lead long, class long, hot boolean")
    held = written(held, "held")
    named = held.select("class").union(held.select(F.col("lead").alias("class"))).distinct()
    members = classes.select("class", "node", "weight").join(named, "class")
    members = written(members.join(profile.select(F.col("__row").alias("node"), "__id", "__h", "n", "sketch"), "node"), "members")

    def packed(nodes: DataFrame) -> DataFrame:
        where = if_small(members.select(F.col("__id").alias("__m"), F.col("__h").alias("__mh"), "node").join(nodes, "node", "left_semi"))
        found = rows.join(where, rows["__id"].eqNullSafe(where["__m"]) & (rows["__h"] == where["__mh"])).select("node", "__text")
        return written(found.mapInArrow(_packed, "node long, packed binary").dropDuplicates(["node"]), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that are linked."""
        texts = packed(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("packed").alias("ta")), "a")
        links = written(both.select("a", "b", "ta", "tb").mapInArrow(lambda it: _confirmed(width, num, den, it), "a long, b long"), "links")
        release(texts)
        return links

    # Each holder meets its key's least holder.
    side = lambda x: members.select(F.col("class").alias("lead" if x == "a" else "class"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    stars = held.select("lead", "class").filter("lead <> class").distinct().join(side("b"), "class").join(side("a"), "lead").filter("a <> b")
    stars = stars.select("lead", "class", "a", "b", "na", "nb", "sa", "sb").mapInArrow(lambda it: _screened(num, den, it), "lead long, class long, a long, b long, status int, may boolean")
    stars = written(stars, "stars")
    links = confirmed(stars.filter("may").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = components(links)
    # Holders in several components.
    state = stars.join(links.select("a", "b", F.lit(LINKED).alias("linked")).union(links.select(F.col("b"), F.col("a"), F.lit(LINKED))), ["a", "b"], "left")
    state = state.select("lead", "class", F.col("b").alias("node"), F.coalesce("linked", "status").alias("status")).join(labels, "node", "left")
    own = members.select("class", "node").join(labels, "node", "left").select("class", "node", F.coalesce("label", "node").alias("label"))
    holders = held.join(state, ["lead", "class"]).select("key", "node", "status", F.coalesce("label", "node").alias("label"), "hot")
    holders = holders.unionByName(held.filter("lead = class").join(own, "class").select("key", "node", F.lit(LINKED).alias("status"), "label", F.lit(False).alias("hot")))
    holders = written(holders, "holders")
    # "hot": other tasks' holders follow this one. If it isn't linked with the key's least holder, distances from that say nothing.
    per_key = holders.groupBy("key").agg(
        F.max("hot").alias("split"), F.max(F.col("hot") & (F.col("status") != LINKED)).alias("loose"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum((F.col("status") != LINKED).cast("int")).alias("out"), F.min(F.when(F.col("status") != LINKED, F.col("status"))).alias("nearest")
    )
    reach = F.when(F.col("split"), FARTHER).otherwise(FAR)  # holders at this status are too far from linked ones
    mixed = per_key.filter((F.col("low") != F.col("high")) & (F.col("loose") | (F.col("out") > 1) | (F.col("nearest") < reach)))
    mixed = mixed.select("key", "split", "loose", (F.col("loose") | (F.col("nearest") < reach)).alias("with_linked"))
    again = holders.drop("hot").join(mixed, "key").filter((F.col("status") != LINKED) | F.col("with_linked"))
    again = again.select("key", "node", F.when(F.col("loose"), NEAR).otherwise(F.col("status")).alias("status"), "label", "split")
    again = written(again.groupBy("key", "node").agg(F.max("status").alias("status"), F.min("label").alias("label"), F.max("split").alias("split")), "mixed")
    cut = _in_blocks(again, "key", "node", 4 * LEAST_BLOCK)
    met, compared, total = None, [], 0
    for fresh in (*FRESH, 1 << 40):
        todo = cut
        if met is not None:
            todo = cut.join(met.filter("key is not null").select("key", "bi", "bj"), ["key", "bi", "bj"], "left_semi")
        todo = todo.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(members.select("node", "n", "sketch"), "node")
        todo = todo.select("key", "bi", "bj", "block", "node", "label", "status", "n", "sketch", "split").repartition(n_parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        total += fresh  # of these, at most total - fresh are compared already
        last, met = met, written(todo.mapInArrow(lambda it, most=total: _met_again(num, den, most, it), _MET), "met")
        release(*[last] if last is not None else [])
        pairs = met.filter("node is not null").select("node", "partner", "gap", "spread").distinct()
        for before in compared:
            pairs = pairs.join(before, ["node", "partner"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("node").orderBy("gap", "spread", "partner"))
        ranked = written(pairs.select("node", "partner", rank.alias("rank")), "ranked")
        more = written(ranked.filter(F.col("rank") <= fresh).select("node", "partner"), "pairs")
        left = ranked.filter(F.col("rank") > fresh).limit(1).count() + met.filter("node is null and key is null").limit(1).count()
        release(ranked)
        compared.append(more)
        if not more.limit(1).count():
            break
        across = confirmed(more.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")))
        if across.limit(1).count():
            was, labels = labels, merged(labels, across)
            release(was)
        release(across)
        if not left:
            break
    release(met, held, stars, links, holders, again, *compared)
    # Back to the rows.
    linked = labels.join(classes.select("node", "least", "weight"), "node")
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    linked = written(linked.join(ids, "label"), "linked")
    release(labels)
    n_links = linked.select("node", F.lit(0).cast("long").alias("n_links"))
    if counted:
        pairs = linked.filter("nodes = 2").groupBy("label").agg(F.sum("weight").alias("__both"))
        twos = linked.filter("nodes = 2").join(pairs, "label").select("node", (F.col("__both") - F.col("weight")).alias("n_links"))
        larger = linked.filter("nodes > 2").select("label", "node", "weight")
        texts = packed(larger.select("node"))
        cut = _in_blocks(larger, "label", "node", LEAST_BLOCK).join(texts, "node").repartition(n_parts, "label", "bi", "bj").sortWithinPartitions("label", "bi", "bj")
        n_links = cut.select("label", "bi", "bj", "block", "node", "weight", "packed").mapInArrow(lambda it: _counted(width, num, den, it), "node long, n_links long")
        n_links = written(n_links.groupBy("node").agg(F.sum("n_links").alias("n_links")).unionByName(twos), "n-links")
        release(texts)
    by_node = linked.select("node", "label", "component_id").join(n_links, "node", "left")
    by_class = classes.select("sig", "node", "least", "weight").join(by_node, "node", "left").select(
        "sig", F.coalesce("label", "node").alias("__c"), F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    by_run = first.select("__run", "sig").join(by_class, "sig")  # a class of a third of all rows is spread over its runs
    back = some.select("__id", "__h", "n", "sig", run).join(by_run, ["__run", "sig"]).select("__id", "__h", "n", "component_id", "n_links", "__c")
    none = profile.filter("n = 0").select("__id", "__h", "n", F.col("__id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("__c"))
    release(members)
    return back.unionByName(none).select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links", "__h", "__c")


def keep_one(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (rows without shingles all stay).

    Components are told apart by their links, not by ids: unlinked rows stay, whether their ids are null or repeat. Of
    rows that repeat the smallest id in one component, one stays, and one of null ids where all ids are null.
    """
    groups = written(_grouped(docs, width, num, den, id_col, text_col, False), "groups")
    key, none = groups[id_col].alias("__k"), (F.col("n_shingles") == 0).alias("__none")
    some = groups.filter((F.col("n_shingles") > 0) & F.col(id_col).eqNullSafe(F.col("component_id")))  # one id in each __c
    repeated = some.groupBy("__c").count().filter("count > 1").limit(1).count()
    stay = some.select("__c", key, F.col("__h").alias("__kh"), none)
    if repeated:
        stay = stay.groupBy("__c", "__k", "__none").agg(F.min("__kh").alias("__kh"))
    stay = stay.select("__k", "__kh", "__none").unionByName(groups.filter("n_shingles = 0").select(key, F.col("__h").alias("__kh"), none).distinct())
    keep = stay.select(F.struct("__k", "__kh", "__none").alias("__keep"))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id_col].alias("__i"), F.xxhash64(docs[text_col]).alias("__h"))
    keep = if_small(keep)
    kept = marked.join(keep, marked["__i"].eqNullSafe(keep["__keep.__k"]) & (marked["__h"] == keep["__keep.__kh"]))
    if repeated:
        kept = kept.filter("__keep.__none").unionByName(kept.filter("not __keep.__none").dropDuplicates(["__i", "__h"]))
    return kept.select("__row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100).drop("__h")


ORACLE = {
    "op3_jaccard_join": """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
t AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
e AS (SELECT DISTINCT r, g FROM t WHERE g IS NOT NULL UNION ALL SELECT r, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)),
s AS (SELECT w.r, doc_id, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT r, count(*) AS n FROM e GROUP BY r) USING (r)),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
b AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS x FROM s UNION SELECT reach.r, b.b FROM reach JOIN b ON reach.x = b.a),
c AS (SELECT reach.r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.x GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS links FROM b GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links FROM s JOIN c USING (r) LEFT JOIN n USING (r)""",
}
QUERIES = {"op3_jaccard_join": op3_jaccard_join}
