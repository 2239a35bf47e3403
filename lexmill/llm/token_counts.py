"""Operator 6, token counts: the whole-token shortcut.

A byte-level vocabulary holds strings that the tokenizer, given nothing else,
encodes as one token. ``whole_tokens`` proves which: it pre-tokenises every
vocabulary string, keeps those that stay one pre-token, runs the merges on them
and keeps those that end as one id. A pre-token of a text found in that set
counts one token without merging; only the others are merged, and their
counts are kept per worker, in at most CACHED bytes.

The proof is made once, on the driver, and sent to the workers. So is the list of characters
of which the pattern used here and the library's splitter think alike (all but a few of the
basic plane): a pre-token's borders depend on nothing but its characters' classes.

Texts are cut before spaces that a non-space follows, where no pre-token
can cross. A piece with a character outside the list, or a pre-token of over bpe.WIDEST bytes, goes to the library, not
its text; only a text that holds an added token goes there whole, as such tokens are cut out first. So counts equal the library's.

A null text counts as empty (0 bytes, 0 tokens). Very long texts are counted whole; a text without spaces is one piece. Repeated
rows give repeated results; an empty table gives none; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import bpe

LIMIT = 512
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes of pieces and their counts that a worker keeps (PIECE: of a piece beside its text).
CACHED, PIECE = 64 << 20, 160
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_GENERAL = regex.compile(r"\s*\S+|\s+")
#: White space that needs care: runs, ends, and spaces before a line's end.
_RUNS = regex.compile(r"^\s|\s$|\s\s")
_PLAIN = regex.compile(r"[\t\n\r -~¡-ɏ]*")
#: A cut that holds whatever the other characters are.
_CUT = regex.compile(r"(?s).+?(?= [!-~])|.+")


def _alike(library, text: str) -> bool:
    return _PRE.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def alike(path: str, last: int = 0xFFFF) -> str:
    """The characters up to ``last``, as ranges for a pattern, that the pattern and the library put into the same class: beside letters,
    digits, signs and spaces they split alike."""
    library = bpe.library(path)
    probe = lambda c: f"a{c}a 1{c}1 !{c}! {c}a"
    found: list[int] = []
    for first in range(0, last + 1, 64):
        points = [k for k in range(first, min(first + 64, last + 1)) if not 0xD800 <= k < 0xE000]
        found += points if _alike(library, "".join(probe(chr(k)) for k in points)) else [k for k in points if _alike(library, probe(chr(k)))]
    runs = [[k for _, k in run] for _, run in groupby(enumerate(found), lambda x: x[1] - x[0])]
    return "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in runs)


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[bytes]:
    """The vocabulary strings (as bytes) that encode alone as exactly one token: themselves."""
    merger = bpe.merger(path)
    byte_of = {s: b for b, s in enumerate(merger.symbols)}
    strings = []
    for symbol_string in merger.vocab:
        if all(c in byte_of for c in symbol_string):
            raw = bytes(byte_of[c] for c in symbol_string)
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if len(raw) <= bpe.WIDEST and _PLAIN.fullmatch(text) and _PRE.fullmatch(text) and len(_PRE.findall(text)) == 1:
                strings.append(raw)
    _, counts = merger.encode(strings)
    return frozenset(s for s, n in zip(strings, counts.tolist(), strict=True) if n == 1)


@dataclass(frozen=True)
class Proof:
    """What is proven of a vocabulary: the strings that are one token, the characters that split alike; and its added tokens."""

    path: str
    single: frozenset[str]
    alike: str
    added: tuple[str, ...]


@lru_cache(maxsize=4)
def proven(path: str) -> Proof:
    added = sorted(t.content for t in bpe.library(path).get_added_tokens_decoder().values())
    return Proof(path, frozenset(s.decode() for s in whole_tokens(path)), alike(path), tuple(added))


class Counter:
    """Tokens of pieces between cuts, kept per worker process."""

    def __init__(self, proof: Proof):
        self.path, self.single = proof.path, proof.single
        self.odd = regex.compile(f"[^{proof.alike}]")
        self.added = regex.compile("|".join(map(regex.escape, proof.added)) or r"(?!)")
        self.known: dict[str, int] = {}
        self.held = 0

    def by_library(self, text: str) -> int:
        return len(bpe.library(self.path).encode(text, add_special_tokens=False).ids)

    def learn(self, pieces: list[str]) -> None:
        merger = bpe.merger(self.path)
        odd = {p for p in pieces if self.odd.search(p)}
        found = {p: self.by_library(p) for p in odd}
        pieces = [p for p in pieces if p not in odd]
        split = [_PRE.findall(p) for p in pieces]
        rest = list(set().union(*split).difference(self.single))
        raw = [t.encode() for t in rest]
        count = dict.fromkeys(self.single, 1)
        short = [k for k, r in enumerate(raw) if len(r) <= bpe.WIDEST]
        _, n = merger.encode([raw[k] for k in short])
        count.update(zip((rest[k] for k in short), n.tolist(), strict=True))
        count.update((t, self.by_library(t)) for t, r in zip(rest, raw, strict=True) if len(r) > bpe.WIDEST)
        get = count.__getitem__
        found.update((p, sum(map(get, s))) for p, s in zip(pieces, split, strict=True))
        self.known.update(found)
        self.held += sum(PIECE + 4 * len(p) for p in found)

    def pieces(self, text: str) -> list[str]:
        if not _PLAIN.fullmatch(text) and self.odd.search(text):
            return _CUT.findall(text)
        if _RUNS.search(text):
            return _GENERAL.findall(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *(w if w[:1] == "\n" else f" {w}" for w in rest)]

    def of(self, texts: list[str]) -> list[int]:
        split: list[list[str] | int] = [self.by_library(t) if self.added.search(t) else self.pieces(t) if t else [] for t in texts]
        if self.held > CACHED:
            self.known, self.held = {}, 0
        if missing := set().union(*(s for s in split if isinstance(s, list))).difference(self.known):
            self.learn(list(missing))
        get = self.known.__getitem__
        return [s if isinstance(s, int) else sum(map(get, s)) for s in split]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit; one row per row, without a shuffle."""
    proof = docs.sparkSession.sparkContext.broadcast(proven(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(proof.value)
        counter = _counters[path]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = np.array(counter.of(texts), np.int64)
                n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, COUNTS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
