"""Vectorised word and shingle hashing over Arrow string arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; separators are
ASCII, so working on UTF-8 bytes is exact. Hashes are 64 bits wide. Words are
hashed for a whole block of texts at once (a polynomial over random byte codes,
then a finaliser), without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in blocks of about so many bytes; only a longer single text exceeds it.
BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_IS_LETTER = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two rounds of shift, xor and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; tables for a text over 2 * BLOCK_BYTES are not kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 2 * BLOCK_BYTES:
        _powers[:] = made
    return made[0], made[1]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets, bytes) of blocks of texts; a null counts as empty. Nothing is copied unless there are nulls."""
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1)
        yield first, last, ends[first : last + 1] - ends[first], raw[ends[first] : ends[last]]
        first = last


def words(offsets: np.ndarray, raw: np.ndarray, lower: bool = True, prefix: int = 0, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, or of its first ``prefix`` bytes; first word of each text: one more entry than texts).

    With ``letters``, words are runs of ASCII letters, digits and bytes of other characters instead.
    """
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = (_IS_LETTER if letters else _IS_WORD)[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    before[cuts] = False  # a text's first byte begins a word, whatever ends the text before
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[_LOWER[raw] if lower else raw] * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets)


_STEPS = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``width`` words, or of all the words of a shorter text."""
    hashes, first = words(offsets, raw)
    n = len(hashes)
    if n >= width:
        sums = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            sums += hashes[k : n - width + 1 + k] * _STEPS[k]
        sums = mix(sums)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            found = np.sort(sums[a : b - width + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif b > a:
            yield mix(np.array([(hashes[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
