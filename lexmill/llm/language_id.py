"""Operator 5, language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed greedily against each automaton: the longest match is one
phrase, then the next begins. The language with the fewest phrases, normalised
to bits per symbol (phrases times log2 of the reference length, by the text's symbols), wins.

Letters are lower-cased; every run of other characters is one space. Only
letters of the sample have symbols of their own, at most ALPHABET of them; others share
FOLDED classes. Texts are cut into blocks of BLOCK symbols that all languages
and many texts parse in step (numpy). Blocks are parsed again until each begins in the state in which the one
before ends, so phrases cross blocks and are those of one parse of the whole text.

The sample is bounded: about ROWS documents of each language, chosen by a hash
of their id, of which texts are taken until TRAINED characters are reached; of the last one
only its first characters that still fit, so long texts count and no labelled language is left out.
Everything else covers all rows, in one pass and without a shuffle.

A null text, or one without a letter, is ``und`` with score 0, and so is every
text if nothing is labelled. Ties go to the first language in order of name. Every row gives
a row; an empty table gives none; a null doc_id is neither held out nor learned from; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, TRAINED = 200, 40_000
ALPHABET, FOLDED = 96, 16
BLOCK, CHARS, ROWS_AT_ONCE = 256, 1 << 19, 500
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _squeezed(symbols: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Keeps one space (symbol 0) of each run, none before a text's first letter; heads: where texts begin."""
    before = np.empty_like(symbols)
    before[:1] = 0
    before[1:] = symbols[:-1]
    before[heads[heads < len(symbols)]] = 0
    return (symbols != 0) | (before != 0)


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    nexts, links, lengths, last = [{}], [-1], [0], 0
    for c in text:
        made = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = made
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[q] == lengths[p] + 1:
                links[made] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = links[p]
                links[q] = links[made] = copy
        last = made
    return nexts


class Model:
    """Automata of all languages as one table: entry (state, symbol) is the next state's row, negative where a phrase ends."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        points = [_points(t) for texts in samples.values() for t in texts]
        seen = np.concatenate(points) if points else np.zeros(0, np.uint32)
        seen = seen[_letters()[seen]]
        letters, counts = np.unique(seen, return_counts=True)
        own = np.sort(letters[np.argsort(-counts, kind="stable")[:ALPHABET]])
        self.own, self.width = own, len(own) + FOLDED + 1
        rows, self.roots, self.bits = [], [], []
        at = 1  # no state has row 0, so signs tell
        for language in self.languages:
            text = []
            for t in samples[language]:
                symbols = self.symbols(_points(t))
                text += [*symbols[_squeezed(symbols, np.zeros(1, np.int64))].tolist(), 0]
            nexts = suffix_automaton(text)
            root = np.full(self.width, -at, np.int64)
            for c, s in nexts[0].items():
                root[c] = -(at + s)
            table = np.tile(root, (len(nexts), 1))
            of = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
            table[of, np.fromiter((c for x in nexts for c in x), np.int64, len(of))] = at + np.fromiter((s for x in nexts for s in x.values()), np.int64, len(of))
            rows.append(table)
            self.roots.append(at)
            self.bits.append(math.log2(max(2, len(text))))
            at += len(nexts)
        tables = np.concatenate([np.zeros((1, self.width), np.int64), *rows]) * self.width
        self.table = tables.astype(np.int32 if at * self.width < 1 << 31 else np.int64).ravel()

    def symbols(self, points: np.ndarray) -> np.ndarray:
        kinds = np.zeros(0x110000, np.int16)
        if not hasattr(self, "kinds"):
            letters = np.flatnonzero(_letters())
            kinds[letters] = 1 + len(self.own) + letters % FOLDED
            kinds[self.own] = 1 + np.arange(len(self.own))
            self.kinds = kinds
        return self.kinds[points]

    def _run(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, phrases ended) of each language after blocks of falling sizes, from the states in which they are entered."""
        states, counts = entered, np.zeros(entered.shape, np.int32)
        for step in range(int(size[0])):
            n = int(np.searchsorted(-size, -step, side="left"))  # blocks of more than ``step`` symbols
            moved = self.table.take(states[:, :n] + padded[start[:n] + step])
            counts[:, :n] += moved < 0
            np.abs(moved, out=moved)
            states[:, :n] = moved
        return states, counts

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each language and text, symbols of each text)."""
        lowered = [t.lower() for t in texts]
        lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
        symbols = self.symbols(np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32))
        heads = np.cumsum(lengths) - lengths
        keep = _squeezed(symbols, heads)
        before = np.concatenate(([0], np.cumsum(keep)))
        first = before[heads]
        sizes = before[heads + lengths] - first
        symbols = symbols[keep]
        n_blocks = -(-sizes // BLOCK)
        text_of = np.repeat(np.arange(len(texts)), n_blocks)
        k = np.arange(len(text_of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start, size = first[text_of] + k * BLOCK, np.minimum(BLOCK, sizes[text_of] - k * BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size, text_of = start[order], size[order], text_of[order]
        # A block begins in the state in which the one before ends. All are first parsed from the root; those whose true first state is another are
        # parsed again, until none is: phrases soon meet whatever they began with, so few blocks go on after the second turn.
        roots = np.array(self.roots, self.table.dtype)[:, None] * self.width
        counts = np.zeros((len(self.languages), len(start)), np.int32)
        entered = np.repeat(roots, len(start), axis=1)
        left = entered.copy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # of the blocks in text order
        follows = place[np.flatnonzero(k > 0)]
        before = place[np.flatnonzero(k > 0) - 1]
        padded = np.concatenate((symbols, np.zeros(1, symbols.dtype)))
        todo = np.arange(len(start))
        while len(todo):
            left[:, todo], counts[:, todo] = self._run(padded, start[todo], size[todo], entered[:, todo])
            late = (entered[:, follows] != left[:, before]).any(axis=0)
            entered[:, follows[late]] = left[:, before[late]]
            todo = np.sort(follows[late])
        last = place[np.flatnonzero(np.append(k[1:] == 0, True))] if len(k) else place
        counts[:, last] += left[:, last] != roots  # a phrase that the text's end cuts
        phrases = np.stack([np.bincount(text_of, c, len(texts)) for c in counts]) if len(start) else np.zeros((len(self.languages), len(texts)))
        return phrases, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        phrases, sizes = self.parse([t or "" for t in texts])
        entropy = phrases * np.array(self.bits)[:, None] / np.maximum(1, sizes)
        best = entropy.argmin(axis=0)
        ranked = np.sort(entropy, axis=0)
        score = 1 - ranked[0] / np.maximum(ranked[1], 1e-12) if len(self.languages) > 1 else np.ones(len(texts))
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)], np.where(sizes > 0, np.clip(score, 0, 1), 0.0).tolist()


def _remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def learn(docs: DataFrame, rows: int = ROWS, trained: int = TRAINED) -> Model:
    """Fits on the bounded sample of labelled rows that are not held out."""
    labelled = docs.where((_remainder() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, rows / n) * (1 << 30)))])
    drawn = labelled.select("lang", F.substring("text", 1, trained).alias("text"), "doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)).alias("draw")).where(F.col("draw") < limit[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    left = trained - F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = drawn.withColumn("left", left.cast("int")).where("left > 0").withColumn("text", F.expr("substring(text, 1, left)"))
    samples: dict[str, list[str]] = {}
    for r in sorted(taken.select("lang", "draw", "doc_id", "text").collect()):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples)


def _predicted(model: Model, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    languages, scores, part, size = [], [], [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t or "")
        if size >= CHARS or k == len(texts) - 1:
            for out, got in zip((languages, scores), model.predict(part), strict=True):
                out += got
            part, size = [], 0
    return pa.array(languages, pa.string()), pa.array(scores, pa.float64())


def with_language(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns, and the language and its score under these names (not the table's own); without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                found = _predicted(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *names])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score: one row per row."""
    return with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(_remainder() == 0, F.lit(False))
    return identify(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
