"""Operator 1, packing: harmonic classes filled independently by each worker.

Token lengths are dealt into reciprocal-capacity classes: class k holds pieces
of more than capacity/(k+1) and at most capacity/k tokens, and each of its bins
takes exactly k pieces. A document gives whole sequences first; of what is left, the most
tokens that a class holds exactly (``capacity // k`` for the least k that fits) are cut for that class, and so on with the
rest, so that bins of all classes fill up with little padding (fewer than k tokens each). What is at most
``capacity // MOST`` tokens, or leaves bins of its class at most SLACK tokens of padding, goes to its class as it is. At the end of a worker's rows the pieces of bins that are not full are laid
end to end, cut at sequence ends, and the last, unfinished sequence is cut into
sequences whose lengths are powers of two.

Nothing is shuffled: every task packs its own rows, holds at most one open bin
per class, and numbers its sequences ``task << 40 | n``; a lost task is packed
again from the same rows to the same result. A very long text is read whole, as one row; the ids of words are kept
up to CACHED_BYTES a worker process, those met last; others are learned again.

A null text counts as empty: its document is its end token alone. Repeated rows and
repeated document ids are packed row by row; a null id stays null. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

CAPACITY = 2048
END_ID = 1
#: A rest of at most CAPACITY // MOST tokens is not cut any more.
MOST = 32
#: A rest is not cut either if its class's bins would be padded by at most so many tokens.
SLACK = 8
#: Bytes that a worker process keeps of words and their ids, about (less where other stages share the memory); rows that are tokenised at once.
CACHED_BYTES, ROWS = 96 << 20, 256
#: Bytes of two small objects of Python and their entry in a dictionary, besides their contents.
_OBJECTS = 190
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_PRE = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: With other characters, or special strings, a word goes to the library itself.
_ODD = regex.compile(r"[^\t\n\r !-~¡-įı-ɏ]|<\|")


class WordIds:
    """Ids of space-separated words as little-endian bytes; exact because no token crosses a space."""

    def __init__(self, path: str, most: int = CACHED_BYTES):
        self.path, self.known, self.older, self.held, self.most = path, {"": b""}, {}, 0, most

    def learn(self, missing: list[str]) -> None:
        plain = missing
        if _ODD.search("\n".join(missing)):
            plain = [w for w in missing if not _ODD.search(w)]
            for w in missing:
                if _ODD.search(w):
                    self.known[w] = np.array(bpe.library(self.path).encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if not plain:
            return
        letters = [w for w in plain if w.isalpha()]  # these are one pre-token each
        plain = [w for w in plain if not w.isalpha()]
        index: dict[str, int] = {"\n": 0}
        each = [index.setdefault(w.lower(), len(index)) for w in letters]
        codes = np.array([index.setdefault(t, len(index)) for t in _PRE.findall("\n".join([*plain, ""]).lower())], np.int64)
        distinct = [t.encode() for t in index]
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        merged = np.flatnonzero((sizes <= bpe.WIDEST) & (np.arange(len(distinct)) != 0))
        ids, n = bpe.merger(self.path).encode([distinct[k] for k in merged.tolist()])
        counts = np.zeros(len(distinct), np.int64)
        counts[merged] = n
        extra = []
        long = np.flatnonzero(sizes > bpe.WIDEST)
        for k in long.tolist():
            extra.append(np.array(bpe.library(self.path).encode(distinct[k].decode(), add_special_tokens=False).ids, np.uint32))
            counts[k] = len(extra[-1])
        starts = np.zeros(len(distinct), np.int64)
        starts[merged] = np.cumsum(n) - n
        starts[long] = len(ids) + np.cumsum(counts[long]) - counts[long]
        ids = np.concatenate([ids, *extra]).astype("<u4")
        whole, first, last = ids.tobytes(), (4 * starts).tolist(), (4 * (starts + counts)).tolist()
        self.known.update((w, whole[first[k] : last[k]]) for w, k in zip(letters, each, strict=True))
        each = counts[codes]
        ends = np.cumsum(each)
        data = ids[np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = (4 * ends[codes == 0]).tolist()
        self.known.update((w, data[a:b]) for w, a, b in zip(plain, [0, *cuts], cuts, strict=False))

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Only spaces and line feeds cut words here; other white space stays inside a word."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*split)
        if 2 * self.held > self.most:  # words met since the last time stay
            self.known, self.older, self.held = {"": b""}, self.known, 0
        if missing := words.difference(self.known):
            again = [w for w in missing if w in self.older]  # in time of the missing ones, not of all that are kept
            self.known.update((w, self.older[w]) for w in again)
            if new := list(missing.difference(again)):
                self.learn(new)
            self.held += _OBJECTS * len(missing) + 5 * sum(map(len, missing))  # a character and at most one id for each
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]


@lru_cache(maxsize=1)
def _store(path: str, most: int) -> WordIds:
    return WordIds(path, most)


def _binary_parts(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """The bins of one worker. ``add`` and ``finish`` give finished pieces (a row for each, without ids)."""

    def __init__(self, worker: int, capacity: int = CAPACITY, most: int = MOST):
        self.next, self.capacity, self.most = worker << 40, capacity, most
        self.bins: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, length, whole, ids in pieces:
            yield doc, start, length, whole, self.next, offset, ids
            offset += length
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity:
            yield from self._close([(doc, start, self.capacity, total, ids[4 * start : 4 * (start + self.capacity)])])
            start += self.capacity
        while start < total:
            left = total - start
            k = self.capacity // left  # the class of what is left
            if k < self.most and k * left < self.capacity - SLACK:
                k += 1  # and the first one that a part of it fills
            length = min(left, self.capacity // k)
            waiting = self.bins.setdefault(k, [])
            waiting.append((doc, start, length, total, ids[4 * start : 4 * (start + length)]))
            start += length
            if len(waiting) == k:
                yield from self._close(self.bins.pop(k))

    def finish(self) -> Iterator[tuple]:
        loose = [x for k in sorted(self.bins) for x in self.bins[k]]
        self.bins = {}
        left = sum(x[2] for x in loose)
        sizes = [self.capacity] * (left // self.capacity) + _binary_parts(left % self.capacity)
        pieces, room = [], sizes.pop(0) if sizes else 0
        for doc, start, length, whole, ids in loose:
            done = 0
            while done < length:
                n = min(room, length - done)
                pieces.append((doc, start + done, n, whole, ids[4 * done : 4 * (done + n)]))
                done, room = done + n, room - n
                if not room:
                    yield from self._close(pieces)
                    pieces, room = [], sizes.pop(0) if sizes else 0


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, most: int = MOST, end_id: int = END_ID, cached: int = CACHED_BYTES) -> DataFrame:
    """(doc_id, text) -> one row per piece, with its ids (little-endian unsigned 32-bit) and place."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(context.partitionId() if context else 0, capacity, most)
        store = _store(path, cached)
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        out: list[tuple] = []
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), store.of(texts), strict=True):
                    out += packer.add(doc, ids + end)
                if len(out) >= 1000:
                    yield table(out)
                    out = []
        last = packer.finish()
        while out or (out := list(islice(last, 1000))):
            yield table(out)
            out = []
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed; the digest columns of the contract."""
    import public_tokenizers

    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
