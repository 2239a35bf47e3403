"""Operator 11, phrase collocations: prefix-free parsing.

Texts are cut at marks into pieces, and pieces at content-triggered places into chunks: a chunk ends where a
window of OVERLAP words has a hash that is 0 modulo TRIGGER, and the next chunk begins with that same window. Equal
passages are cut alike wherever they stand, so the chunks of copies, of shared passages and of common sentences are the
same. The dictionary of distinct chunks with their frequencies (one shuffle) is written, and everything else counts inside
distinct chunks, weighted. A phrase of at most OVERLAP + 1 words that begins before a chunk's last window lies
within the chunk, and one that begins in that window belongs to the next chunk, so each occurrence counts once; the
last chunk of a piece counts all of its own.

Phrases of n words are counted in passes over the dictionary, by 64-bit hashes and only where both phrases of n - 1 words in
them are frequent. That is looked up in a bitmap of BITS bits, the only thing that is broadcast: of a fixed size, whatever the
corpus; where very many phrases are frequent it lets more candidates through, and never loses one. A last pass
counts what passed as texts, so the counts kept are those of phrases, not of hashes (only within a block of 10,000 chunks are
equal hashes taken for equal phrases). Parts of a frequent phrase are frequent,
so cuts and containment are joins of that table with itself.

Counts are added before each shuffle, in a task over about HELD phrases. The best of a language are limited in every task
before they meet.

Null texts count as empty, null languages as ``und``. Rows are texts of their own, whatever their ids; an empty table gives
no rows; other columns are ignored. A very long text is cut as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordhash
from .shared import Tables

LEAST, LONGEST, MOST, PERCENT = 30, 4, 2000, 80
SCALE = 2_000_000
#: Words that two chunks share, and of how many windows one ends a chunk.
OVERLAP, TRIGGER = LONGEST - 1, 16
#: Bits of the bitmap of frequent phrases; phrases counted at once within a task.
BITS, HELD = 1 << 26, 1 << 20
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd numbers that tell the words of a phrase apart by their place.
_STEPS = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _texts(starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> pa.Array:
    """The stretches of bytes as strings."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[_spread(starts, sizes)]))]).cast(pa.string())


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words that follow each other (as many as have a place)."""
    n = max(0, len(hashes) - size + 1)
    sums = np.full(n, np.uint64(size))
    for k in range(size):
        sums += hashes[k : n + k] * _STEPS[k]
    return wordhash.mix(sums)


def _chunks(offsets: np.ndarray, raw: np.ndarray, overlap: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, words counted here, whether the piece's last, words joined by spaces) of the chunks of a block of texts."""
    raw = _LOWER[raw]
    # one byte more between texts, so that no word and no piece crosses
    row_of_byte = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded = np.full(len(raw) + len(offsets), 10, np.uint8)
    padded[np.arange(len(raw)) + row_of_byte + 1] = raw
    inside = _WORD[padded]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none > 0, pa.array([], pa.string())
    breaks = np.cumsum(_BREAK[padded])[starts]
    sizes = ends - starts + 1
    joined = padded[_spread(starts, sizes)]
    at = np.cumsum(sizes) - sizes  # where each word begins in ``joined``; a space follows it
    joined[at + sizes - 1] = 32
    hashes, _ = wordhash.words(np.array([0, len(joined)]), joined, lower=False)

    n = len(starts)
    begins = np.ones(n + 1, bool)  # a place behind the last word, too
    begins[1:n] = breaks[1:] != breaks[:-1]
    piece_start = np.flatnonzero(begins)
    piece_end = np.repeat(piece_start[1:], np.diff(piece_start))
    cuts = begins.copy()
    fits = np.zeros(n, bool)
    windows = _windows(hashes, overlap)
    fits[: len(windows)] = windows % np.uint64(trigger) == 0
    cuts[:n] |= fits & (np.arange(n) + overlap <= piece_end)
    cut = np.flatnonzero(cuts)
    first, following = cut[:-1], cut[1:]
    last = begins[following]
    end = np.where(last, following, following + overlap)
    bounds = np.append(at, len(joined))
    rows = np.searchsorted(offsets + np.arange(len(offsets)), starts[first] - 1, side="right") - 1
    return rows, following - first, last, _texts(bounds[first], bounds[end] - 1 - bounds[first], joined)


def dictionary(docs: DataFrame, overlap: int = OVERLAP, trigger: int = TRIGGER) -> DataFrame:
    """(lang, text) -> lang, chunk, last, own (words counted in it), n: the distinct chunks and how often the parse holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for a, b, offsets, raw in wordhash.blocks(batch.column("text")):
                rows, own, last, texts = _chunks(offsets, raw, overlap, trigger)
                yield pa.RecordBatch.from_arrays([langs.slice(a, b - a).take(pa.array(rows)).cast(pa.string()), texts, pa.array(last), pa.array(own)], ["lang", "chunk", "last", "own"])

    parsed = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(run, "lang string, chunk string, last boolean, own long")
    return parsed.groupBy("lang", "chunk", "last").agg(F.max("own").alias("own"), F.count("*").alias("n"))


def _salts(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    each = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(each, np.uint64)[coded.indices.to_numpy()]


class _Block:
    """The words of some chunks; phrases of n words by their hashes."""

    def __init__(self, part: pa.RecordBatch, overlap: int):
        _, _, self.offsets, self.raw = next(wordhash.blocks(part.column("chunk"), 1 << 62))
        self.hashes, first = wordhash.words(self.offsets, self.raw, lower=False)
        self.sizes = np.diff(first)
        self.left = np.repeat(first[1:], self.sizes) - np.arange(len(self.hashes))  # words from here to the chunk's end
        counted = np.where(part.column("last").to_numpy(zero_copy_only=False), self.sizes, self.sizes - overlap)
        self.counted = np.arange(len(self.hashes)) - np.repeat(first[:-1], self.sizes) < np.repeat(counted, self.sizes)
        self.salt = np.repeat(_salts(part.column("lang")), self.sizes)
        self.weight = np.repeat(part.column("n").to_numpy(), self.sizes)

    def phrases(self, n: int) -> np.ndarray:
        """The hash of the n words from each place on; meaningless where ``left`` is less than n."""
        out = np.zeros(len(self.hashes), np.uint64)
        found = _windows(self.hashes, n)
        out[: len(found)] = wordhash.mix(found ^ self.salt[: len(found)])
        return out

    def frequent(self, n: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether frequent as far as the bitmap of this length tells) of each place."""
        hashes = self.phrases(n)
        held = self.left >= n
        if bits is not None:
            places = hashes & np.uint64(64 * len(bits) - 1)
            held = held & ((bits[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) > 0)
        return hashes, held


def _added(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, sums of their weights, one place of each)."""
    if not len(hashes):
        return hashes, weights, np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], np.add.reduceat(weights[order], first), order[first]


def _hashed(chunks: DataFrame, n: int, shorter, overlap: int) -> DataFrame:
    """hash, n: what tasks count of the phrases of n words whose two phrases of n - 1 words are in the bitmap ``shorter``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def report() -> pa.RecordBatch:
            hashes, sums, _ = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(sums)], ["hash", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = _Block(batch, overlap)
            chosen = block.counted & (block.left >= n)
            if shorter is not None:
                _, ok = block.frequent(n - 1, shorter.value)
                chosen[:-1] &= ok[:-1] & ok[1:]
            held.append((block.phrases(n)[chosen], block.weight[chosen]))
            if sum(len(h) for h, _ in held) >= HELD:
                yield report()
                held = []
        if held:
            yield report()

    return chunks.select("lang", "chunk", "last", "n").mapInArrow(run, "hash long, n long")


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash, set in the cluster; at most ``bits / 64`` words come to the driver."""
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = frequent.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(hash & {63} as int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def _spelled(chunks: DataFrame, maps: list, overlap: int) -> DataFrame:
    """lang, size, phrase, n: what blocks count of the phrases that the bitmaps (one for each number of words) hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = _Block(batch, overlap)
            inside = block.raw != 32
            starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])) | _marked(block.offsets[:-1], len(inside)))
            ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True])) | _marked(block.offsets[1:] - 1, len(inside))) + 1
            chunk = np.repeat(np.arange(batch.num_rows), block.sizes)
            for n, bits in enumerate(maps, 1):
                hashes, held = block.frequent(n, bits.value)
                places = np.flatnonzero(held & block.counted)
                _, sums, one = _added(hashes[places], block.weight[places])
                one = places[one]
                phrases = _texts(starts[one], ends[one + n - 1] - starts[one], block.raw)
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(chunk[one])), pa.array(np.full(len(one), n, np.int32)), phrases, pa.array(sums)], ["lang", "size", "phrase", "n"])

    return chunks.select("lang", "chunk", "last", "n").mapInArrow(run, "lang string, size int, phrase string, n long")


def _marked(places: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[places] = True
    return out


def frequent_phrases(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST, overlap: int = OVERLAP, bits: int = BITS) -> DataFrame:
    """lang, size, phrase, f: all phrases of up to ``longest`` words that occur ``least`` times; ``chunks`` is the dictionary."""
    context = chunks.sparkSession.sparkContext
    maps: list = []
    for n in range(1, longest + 1):
        counted = _hashed(chunks, n, maps[-1] if maps else None, overlap).groupBy("hash").agg(F.sum("n").alias("n"))
        maps.append(context.broadcast(_bitmap(counted.where(F.col("n") >= least), bits)))
    return _spelled(chunks, maps, overlap).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _wide(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def scored(phrases: DataFrame, percent: int = PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, score: the candidates with their lowest-scoring cut, without those inside a longer one that is about as frequent."""
    whole = phrases.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    parts = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr(f"cast({SCALE} as decimal(38,0)) * a div cast(l + r as decimal(38,0))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("a").alias("a"))

    longer = phrases.where("size > 2").withColumn("w", F.split("phrase", " "))
    longer = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("phrase", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1), lambda at: F.array_join(F.slice("w", at, F.col("m")), " "))))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    inside = F.col("most").isNotNull() & (_wide(F.col("most")) * 100 >= _wide(F.col("a")) * percent)
    return best.join(longer, ["lang", "phrase"], "left").where(~inside).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, percent: int = PERCENT, trigger: int = TRIGGER, bits: int = BITS) -> DataFrame:
    """(lang, text) -> lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of each language."""
    if longest < 2 or bits & (bits - 1) or bits < 64:
        raise ValueError("phrases have two words at least, and the bitmap a power of two of bits")
    overlap = longest - 1
    tables = Tables(docs.sparkSession, "collocations")
    chunks = tables.write("chunks", dictionary(docs, overlap, trigger))
    phrases = tables.write("phrases", frequent_phrases(chunks, least, longest, overlap, bits))
    words = tables.write("words", chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n")))
    tables.drop("chunks")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored(phrases, percent).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return first.join(F.broadcast(words) if words.limit(1001).count() <= 1000 else words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents, by language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \x09]+') IF x <> ''] AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i FROM words, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size),
phrases AS (
  SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * c.f) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1) c
  JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, k + 1, c.size), ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, f, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i
        FROM (SELECT *, unnest(range(2, size)) AS m, string_split(phrase, ' ') AS w FROM phrases WHERE size > 2))),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.f >= 80 * c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
