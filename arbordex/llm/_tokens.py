"""Token ids of whole text columns: the tokenizer's own ids, with each distinct pre-token encoded once.

A tokenizer of the kind "lower case, split by a fixed pattern, byte-level BPE with word ends" never merges across
pre-tokens, so a text's ids are those of its pre-tokens in a row. For texts of ASCII and Latin-1 letters the split is
done on bytes in numpy, pre-tokens are numbered by Arrow's dictionary encoding, and only new ones go through BPE.
All other texts (and all other tokenizers) go through the tokenizer as they are. Tests hold both ways against each other.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from arbordex.llm import _hashing as H

# The normalizer and pre-tokenizer that the byte-wise split stands for. Fixed values.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_CACHE = 150_000

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[H.IS_SPACE] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
_PLAIN = np.zeros(256, dtype=bool)  # bytes that the split understands; C3 leads Latin-1 letters
_PLAIN[32:127] = _PLAIN[9:14] = True
_PLAIN[0x80:0xC0] = True
_PLAIN[0xC3] = True


def _byte_names() -> list[str]:
    """The character by which byte-level BPE names each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class Encoder:
    """Encodes columns with one tokenizer; keeps pre-tokens between calls (and starts anew when it holds _CACHE)."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        model = spec["model"]
        self.split = (
            (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and len(pre) == 2
            and pre[0].get("pattern") == {"Regex": _SPLIT}
            and (pre[0].get("behavior"), pre[0].get("invert")) == ("Removed", True)
            and (pre[1].get("type"), pre[1].get("add_prefix_space"), pre[1].get("use_regex")) == ("ByteLevel", False, False)
            and model.get("type") == "BPE"
            and bool(model.get("end_of_word_suffix"))
            and not model.get("dropout")
        )
        self.marks = [a["content"] for a in spec.get("added_tokens") or []]
        if self.split:
            bare = spec | {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
            self.bpe = Tokenizer.from_str(json.dumps(bare))
            self.ends = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
            names = _byte_names()
            self.names = {b: names[b] for b in range(256)}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # ids, and where each pre-token's start

    def _learn(self, fresh: list[bytes]) -> None:
        for i in range(0, len(fresh), 5000):
            part = fresh[i : i + 5000]
            text = b" ".join(part).decode("latin1").translate(self.names | {32: " "})
            ids = np.array(self.bpe.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise AssertionError("pre-tokens and word ends differ")
            n, used = len(self.known), int(self.at[len(self.known)])
            while len(self.flat) < used + len(ids):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while len(self.at) < n + len(part) + 1:
                self.at = np.concatenate((self.at, np.zeros_like(self.at)))
            self.flat[used : used + len(ids)] = ids
            self.at[n + 1 : n + len(part) + 1] = used + ends
            self.known.update(zip(part, range(n, n + len(part)), strict=True))

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """By document: whether the byte-wise split holds for it."""
        odd = ~_PLAIN[raw]
        lead = np.flatnonzero(raw == 0xC3)
        after = raw[np.minimum(lead + 1, len(raw) - 1)]
        odd[lead[(after < 0x80) | (after > 0xBF) | (after == 0x97) | (after == 0xB7)]] = True  # no letter: multiplication and division signs
        follow = (raw >= 0x80) & (raw < 0xC0)
        alone = follow.copy()
        alone[1:] &= raw[:-1] != 0xC3
        odd |= alone
        for mark in self.marks:
            m = np.frombuffer(mark.encode(), np.uint8)
            if len(raw) >= len(m):
                at = np.flatnonzero(raw[: len(raw) - len(m) + 1] == m[0])
                for k in range(1, len(m)):
                    at = at[raw[at + k] == m[k]]
                odd[at] = True
        bad = np.concatenate(([0], np.cumsum(odd)))
        return bad[offsets[1:]] == bad[offsets[:-1]]

    def _encode_plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by document) of documents that are plain."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        low = H.LOWER_AZ[raw]
        second = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3)) + 1
        low[second] += 0x20  # capital letters of Latin-1
        kind = _KIND[raw]
        cut = np.ones(n + 1, dtype=bool)
        cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[offsets] = True
        mark = np.flatnonzero((low == 39) & cut[:-1])
        if len(mark):  # 's 't 'm 'd and 're 've 'll, where no other sign comes before
            end = offsets[np.searchsorted(offsets, mark, side="right")]
            one = np.where(mark + 1 < end, low[np.minimum(mark + 1, n - 1)], 0)
            two = np.where(mark + 2 < end, low[np.minimum(mark + 2, n - 1)], 0)
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))
            for which, size in ((short, 2), (long, 3)):
                cut[mark[which] + 1] = False
                cut[mark[which] + size] = True
        edges = np.flatnonzero(cut)
        solid = kind[edges[:-1]] != _SPACE
        start, size = edges[:-1][solid], np.diff(edges)[solid]
        data = low[kind != _SPACE]
        places = np.concatenate(([0], np.cumsum(size)))
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > _CACHE:
            self._clear()
        known = self.known
        self._learn([w for w in distinct if w not in known])
        number = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        at = self.at[number]
        count = self.at[number + 1] - at
        before = np.concatenate(([0], np.cumsum(count)))
        ids = self.flat[np.repeat(at - before[:-1], count) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(start, offsets)])

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by document), end_id after each document's ids; nulls count as empty."""
        raw, offsets = H.text_bytes(column)
        docs = len(offsets) - 1
        plain = self._plain(raw, offsets) if self.split else np.zeros(docs, dtype=bool)
        size = np.zeros(docs, dtype=np.int64)
        odd = np.flatnonzero(~plain)
        others: list[np.ndarray] = []
        if len(odd):
            texts = [raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace") for d in odd]
            others = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            size[odd] = [len(x) for x in others]
            inside = np.repeat(plain, np.diff(offsets))
            raw_plain, lengths = raw[inside], np.diff(offsets)[plain]
        else:
            raw_plain, lengths = raw, np.diff(offsets)
        ids, counts = self._encode_plain(raw_plain, np.concatenate(([0], np.cumsum(lengths))))
        size[plain] = counts
        ends = np.cumsum(size + 1)
        out = np.full(int(ends[-1]) if docs else 0, end_id, dtype=np.uint32)
        first = ends - size - 1
        own = np.flatnonzero(plain)
        shift = np.repeat(first[own] - np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
        out[shift + np.arange(len(ids))] = ids
        for d, x in zip(odd, others, strict=True):
            out[first[d] : first[d] + len(x)] = x
        return out, np.concatenate(([0], ends))
