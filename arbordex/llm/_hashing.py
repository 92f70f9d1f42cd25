"""Vectorised hashing of whole Arrow string columns (numpy, no per-word Python).

Everything here works on one Arrow batch at a time: memory is a small multiple of the batch's text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_LUT = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply / xor-shift), so that low and high bits are both usable."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


class _Powers:
    """p^i and p^-i mod 2^64, grown on demand and kept for the life of the worker."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            self.up = np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, _P, dtype=np.uint64))))
            self.down = np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, _PINV, dtype=np.uint64))))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def give_back() -> None:
    """Memory that this worker has freed goes back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, rows: int = 2000, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows and about `size` bytes of text (a longer text is a part of its own)."""
    _, offsets = text_bytes(batch[column])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of lut[raw[k]] * p^k over i <= k < j (mod 2^64)."""
    up, _ = POWERS.get(len(raw) + 1)
    h = np.zeros(len(raw) + 1, dtype=np.uint64)
    t = _LUT[raw]
    t *= up[: len(raw)]
    np.cumsum(t, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of raw[start:end], from the prefix hash."""
    _, down = POWERS.get(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64) * U64(0x2545F4914F6CDD1D))


_M31 = U64((1 << 31) - 1)
_BASES = (1_220_703_125, 1_078_318_381)
_LUTS = tuple(np.random.Generator(np.random.PCG64(x)).integers(1, 1 << 31, 256, dtype=np.uint64) for x in (41, 43))


class _FieldPowers:
    """Powers of the bases and of their inverses in the field of 2^31 - 1 elements, kept for the life of the worker."""

    def __init__(self) -> None:
        self.tables = [np.ones(1, np.uint32)] * 4

    def get(self, n: int) -> list[np.ndarray]:
        size = len(self.tables[0])
        while size < n:
            for i, base in enumerate((*_BASES, *(pow(b, -1, int(_M31)) for b in _BASES))):
                step = U64(pow(base, size, int(_M31)))
                self.tables[i] = np.concatenate((self.tables[i], (self.tables[i] * step % _M31).astype(np.uint32)))
            size *= 2
        return [t[:n] for t in self.tables]


_FIELD = _FieldPowers()


def field_prefix(raw: np.ndarray) -> list[np.ndarray]:
    """Prefix sums of two polynomial hashes in a prime field: unlike prefix_hash(), no texts collide by construction."""
    powers = _FIELD.get(len(raw) + 1)
    out = []
    for lut, up in zip(_LUTS, powers, strict=False):
        t = lut[raw]
        t *= up[: len(raw)]
        low = t & _M31
        t >>= U64(31)
        t += low
        h = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(t, out=h[1:])
        out.append(h)
    return out


def field_span(h: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62 bits of raw[start:end], wherever it stands, mixed with its length."""
    down = _FIELD.get(len(h[0]))[2:]
    one, two = ((x[end] - x[start]) % _M31 * d[start] % _M31 for x, d in zip(h, down, strict=True))
    return mix(((one << U64(31)) | two) + (end - start).astype(np.uint64) * U64(0x2545F4914F6CDD1D))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes outside ASCII white space, never across documents.

    Returns start and end of each word, and for each document the index of its first word (length n + 1).
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = solid[1:] != solid[:-1]
    edge[0] = edge[n] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = solid[cuts[:-1]]
    start, end = cuts[:-1][keep], cuts[1:][keep]
    return start, end, np.searchsorted(start, offsets)


def word_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for every word, equal for equal bytes only (no hash decides)."""
    solid = np.zeros(len(raw) + 1, dtype=np.int8)
    solid[start] = 1
    solid[end] -= 1
    data = raw[np.cumsum(solid[:-1]).astype(bool)]
    at = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def exact_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text as sorted numbers, equal for equal words only: (numbers, offsets by text).

    Each round names pairs (shingle so far, next word) by their rank, so nothing is hashed.
    """
    sizes = [len(t) for t in texts]
    raw = LOWER_AZ[np.frombuffer(b"".join(texts), np.uint8)]
    start, end, first = words(raw, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    codes = word_codes(raw, start, end) + 1
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(codes)) - first[doc]
    starts = np.flatnonzero((place <= n_words[doc] - width) | (place == 0))
    name = codes[starts]
    last = first[doc[starts] + 1]
    for k in range(1, width):
        at = starts + k
        following = np.where(at < last, codes[np.minimum(at, len(codes) - 1)], 0)  # 0: the text ended, so it is short
        name = np.unique((name << 32) | following, return_inverse=True)[1] + 1
    top = int(name.max()) + 1
    both = np.unique(doc[starts] * top + name)
    return both % top, np.concatenate(([0], np.cumsum(np.bincount(both // top, minlength=len(texts)))))


def shingles(column: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of every text as sorted 64-bit hashes: (hashes, offsets by document).

    Words are lower-cased in A-Z only. A text with fewer than `width` words has its whole word sequence as one
    shingle (hashed apart from full ones by its length); a text without words has none.
    """
    raw, offsets = text_bytes(column)
    raw = LOWER_AZ[raw]
    start, end, first = words(raw, offsets)
    w = field_span(field_prefix(raw), start, end)
    n_words = np.diff(first)
    if len(w) >= width:
        s = np.zeros(len(w) - width + 1, dtype=np.uint64)
        for k in range(width):
            s = mix(s * U64(0x9FB21C651E98DF25) + w[k : len(w) - width + 1 + k] + U64(k + 1))
    else:
        s = np.zeros(0, dtype=np.uint64)
    parts, sizes = [], np.zeros(len(n_words), dtype=np.int64)
    for d, (f, m) in enumerate(zip(first[:-1].tolist(), n_words.tolist(), strict=True)):
        if m >= width:
            part = np.sort(s[f : f + m - width + 1])
            if len(part) > 1:
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif m:
            acc = np.zeros(1, dtype=np.uint64)
            for k in range(m):
                acc = mix(acc * U64(0x9FB21C651E98DF25) + w[f + k] + U64(1000 * m + k))
            part = acc
        else:
            continue
        parts.append(part)
        sizes[d] = len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))
