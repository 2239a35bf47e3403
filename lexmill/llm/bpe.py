"""Byte-pair merging of many words at once, in step, with numpy.

``Merger`` reads the vocabulary and the ranked merges of a ``tokenizers`` file.
All words of a call become rows of one matrix of ids; each step merges, in every
row, its pair of lowest rank (the leftmost of equals), until no row has a pair.
That is the library's own rule, so ids and counts are equal to its results.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

_NONE = np.uint32(0xFFFFFFFF)
#: Longer words (in bytes) go to the library: a step costs a row's whole width.
WIDEST = 64


def _byte_symbols() -> list[str]:
    """The printable symbol that a byte-level vocabulary uses for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Merger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.symbols = _byte_symbols()
        self.inner = np.array([self.vocab.get(s, 0) for s in self.symbols], np.uint32)
        self.last = np.array([self.vocab.get(s + suffix, 0) for s in self.symbols], np.uint32)
        keys, ranks, made = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(self.vocab[a] << 16 | self.vocab[b])
            ranks.append(rank)
            made.append(self.vocab[a + b])
        self.made = np.array(made, np.uint32)
        self.levels: list[tuple[np.uint32, np.ndarray, np.ndarray]] = []
        left = dict(zip(reversed(keys), reversed(ranks), strict=True))
        multiplier = 0x9E3779B1
        while left:
            slot_keys, slot_ranks, rest = np.full(1 << 18, _NONE), np.full(1 << 18, _NONE), {}
            for k, r in left.items():
                h = (k * multiplier & 0xFFFFFFFF) >> 14
                if slot_keys[h] == _NONE:
                    slot_keys[h], slot_ranks[h] = k, r
                else:
                    rest[k] = r
            self.levels.append((np.uint32(multiplier), slot_keys, slot_ranks))
            left, multiplier = rest, multiplier * 0x85EBCA6B & 0xFFFFFFFF | 1

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.uint32(16) | right
        out = np.full(key.shape, _NONE)
        for multiplier, slot_keys, slot_ranks in self.levels:
            h = (key * multiplier) >> np.uint32(14)
            hit = slot_keys[h] == key
            out[hit] = slot_ranks[h[hit]]
        return out

    def _merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: a row of ids for each word, of ``sizes`` valid entries; merged in place."""
        columns = np.arange(ids.shape[1] - 1) if ids.shape[1] > 1 else np.zeros(0, int)
        if not len(columns):
            return ids, sizes
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        ranks[columns[None, :] >= (sizes - 1)[:, None]] = _NONE
        rows = np.arange(len(ids))
        while len(rows):
            at = ranks[rows].argmin(axis=1)
            low = ranks[rows, at]
            some = low != _NONE
            rows, at, low = rows[some], at[some], low[some]
            if not len(rows):
                break
            shifted = columns[None, :] + (columns[None, :] > at[:, None])  # skips the right half of the pair
            part = ids[rows]
            part[np.arange(len(rows)), at] = self.made[low]
            part[:, :-1] = np.take_along_axis(part, shifted, axis=1)
            ids[rows] = part
            sizes[rows] -= 1
            n = sizes[rows]
            r = np.full((len(rows), len(columns) + 1), _NONE)
            r[:, :-1] = ranks[rows]
            r = np.take_along_axis(r, shifted, axis=1)
            line = np.arange(len(rows))
            new = self._ranks(part[line, at], part[line, np.minimum(at + 1, part.shape[1] - 1)])
            r[line, np.minimum(at, r.shape[1] - 1)] = np.where(at + 1 < n, new, _NONE)
            before = at > 0
            b, k = line[before], at[before] - 1
            r[b, k] = self._ranks(part[b, k], part[b, k + 1])
            r[columns[None, :] >= (n - 1)[:, None]] = _NONE
            ranks[rows] = r
        return ids, sizes

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, one word after the other; ids of each word) for non-empty words of at most WIDEST bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        counts = np.zeros(len(words), np.int64)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in (6, 9, 12, 16, 24, WIDEST):
            group = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for part in np.array_split(group, max(1, len(group) // 20000)):
                if not len(part):
                    continue
                at = np.minimum(first[part, None] + np.arange(width)[None, :], len(raw) - 1)
                ids, n = self.inner[raw[at]], sizes[part].copy()
                ids[np.arange(len(part)), n - 1] = self.last[raw[first[part] + n - 1]]
                ids, n = self._merge(ids, n)
                counts[part] = n
                kept.append((part, ids))
        out = np.zeros(int(counts.sum()), np.uint32)
        start = np.cumsum(counts) - counts
        for part, ids in kept:
            n = counts[part]
            valid = np.arange(ids.shape[1])[None, :] < n[:, None]
            out[(start[part, None] + np.arange(ids.shape[1])[None, :])[valid]] = ids[valid]
        return out, counts


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(maxsize=4)
def library(path: str):
    """The library's tokenizer of a file, one per process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
