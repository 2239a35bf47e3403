"""Operator 12, periodic runs: string synchronising sets over the words of a text.

A run is a stretch of words with smallest period q, at least 2q long, that no neighbouring word extends. All
documents of a block stand one after the other, with a barrier behind each. Windows of ``2**k`` words get exact
names (equal names, equal words of one document) by naming pairs of names, and only windows that occur again in
their document are carried to the next scale, so texts without repetition end after a few scales.

At the scale t a position belongs to the synchronising set if, of the t-word windows that begin in the ``t + 1`` places from
it on, the one of least hash is the first or the last. This depends on the next 2t words alone (its context), so a run of
period q with ``3t <= q < 6t`` holds equal contexts q apart: every two positions of equal context and such a distance propose
that period. The scales t = 2, 4, 8 ... cover all periods from 6 on. Windows of period at most t/3 get no
hash, so that equal contexts lie more than t/3 apart and proposals stay linear in the words. What this leaves out is found
beside it: periods below 6 by comparing each word with those before it; and runs whose first period is itself
highly periodic, from the run of that small period: where it ends, the words ahead tell the phase, and every
period of that phase is proposed. A proposal is checked by extending it to both sides as far as the words agree, through the names; of
proposals with the same stretch the smallest period counts.

Nothing is shuffled; a task holds one block of about BLOCK words, or one longer text, with up to some 200 bytes a word.

A null text has no words and no run. Repeated rows and ids give a row each. An empty table gives none; other columns are
ignored. Words are compared as bytes; separators are ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, let
from .wordhash import mix

#: A run has at least so many words (and two periods).
LEAST = 12
#: Periods below it are compared directly; the least scale covers periods from it on.
DIRECT = 6
#: Words of the texts that are searched at once, about.
BLOCK = 1 << 17
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_NO_HASH = np.uint64(0xFFFFFFFFFFFFFFFF)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number from 1 of each key, 0 for a key that occurs once only; whether it occurs again)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    again = np.diff(np.append(first, len(keys))) > 1
    group = np.cumsum(new) - 1
    out = np.empty(len(keys), np.int64)
    out[order] = np.where(again, np.cumsum(again), 0)[group]
    return out, out > 0


def scales(codes: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words from each place on; 0 where a window occurs once. Codes are equal for equal words of one document."""
    names = [_numbered(codes)[0]]
    places = np.flatnonzero(names[0])
    while len(places):
        last, width = names[-1], 1 << (len(names) - 1)
        places = places[places + width < len(codes)]
        places = places[last[places + width] > 0]
        if not len(places):
            break
        number, again = _numbered(last[places] * (int(last.max()) + 1) + last[places + width])
        out = np.zeros(len(codes), np.int64)
        out[places] = number
        places = places[again]
        if not len(places):
            break
        names.append(out)
    return names


def _agreeing(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from a and from b on agree, and how many just before them (a < b)."""
    size = len(names[0])
    ahead, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        name, width = names[k], 1 << k
        here, there = a + ahead, b + ahead
        here[there >= size], there[there >= size] = 0, 0
        same = (here < there) & (name[here] == name[there]) & (name[here] > 0)
        ahead[same] += width
        here, there = a - back - width, b - back - width
        there[here < 0], here[here < 0] = 0, 0
        same = (here < there) & (name[here] == name[there]) & (name[here] > 0)
        back[same] += width
    return ahead, back


def _checked(names: list[np.ndarray], a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the stretches around a in which words q apart agree, where they hold two periods."""
    ahead, back = _agreeing(names, a, a + q)
    found = np.stack([a - back, back + ahead + q, q], axis=1)[back + ahead >= q]
    return np.unique(found, axis=0)


def _least_ahead(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place on (width is a power of two and one more)."""
    least, have = hashes, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[:-1], least[1:])


def _direct(codes: np.ndarray, q: int) -> np.ndarray:
    """Runs in which words q apart agree, of two periods at least, by comparing every word with that one."""
    same = np.zeros(len(codes) + 1 - q, np.int8)
    same[1:-1] = codes[: -q - 1] == codes[q:-1]  # the last place is a barrier
    turns = np.flatnonzero(np.diff(same))
    begin, end = turns[::2], turns[1::2]
    long = end - begin >= q
    return np.stack([begin[long], (end - begin)[long] + q, np.full(long.sum(), q)], axis=1)


def _proposed(names: list[np.ndarray], k: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of pairs of equal contexts at scale 2**k, 3 to 6 times the scale apart."""
    t = 1 << k
    name, context = names[k], names[k + 1]
    hashes = np.where(name > 0, mix(name.astype(np.uint64)) >> np.uint64(1), _NO_HASH)
    small = runs[(runs[:, 2] <= t // 3) & (runs[:, 1] >= t)]
    if len(small):  # windows inside runs of small periods
        inside = np.zeros(len(name) + 1, np.int64)
        np.add.at(inside, small[:, 0], 1)
        np.add.at(inside, small[:, 0] + small[:, 1] - t + 1, -1)
        hashes[np.cumsum(inside)[:-1] > 0] = _NO_HASH
    if len(hashes) < t + 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _least_ahead(hashes, t + 1)
    n = len(least)
    chosen = np.flatnonzero((least != _NO_HASH) & (context[:n] > 0) & ((least == hashes[:n]) | (least == hashes[t : n + t])))
    order = np.lexsort((chosen, context[chosen]))
    at, what = chosen[order], context[chosen][order]
    found_a, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step, open_ = 1, np.arange(len(at))
    while True:  # contexts that are equal lie more than t/3 apart, so this ends after fewer than 18 steps
        open_ = open_[open_ + step < len(at)]
        far = at[open_ + step] - at[open_]
        near = (what[open_ + step] == what[open_]) & (far < 6 * t)
        open_, far = open_[near], far[near]
        if not len(open_):
            return np.concatenate(found_a), np.concatenate(found_q)
        found_a.append(at[open_][far >= 3 * t])
        found_q.append(far[far >= 3 * t])
        step += 1


def _phased(names: list[np.ndarray], k: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) for runs whose first period lies in a run of a small period p: the phase of what stands where that run ends."""
    t = 1 << k
    small = runs[(runs[:, 2] <= t // 3) & (runs[:, 1] >= 3 * t)]
    found_a, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, length, p in small.tolist():
        end = start + length
        name = names[(p - 1).bit_length()]  # windows of at least p words
        width = 1 << (p - 1).bit_length()
        if end >= len(name) or not name[end]:
            continue
        places = np.arange(end - width - p + 1, end - width + 1)
        for place in places[(places >= start) & (name[places] == name[end])].tolist():
            first = end - place + max(0, -(-(3 * t - (end - place)) // p)) * p
            q = np.arange(first, min(6 * t, end - start + 1), p)
            found_a.append(end - q)
            found_q.append(q)
    return np.concatenate(found_a), np.concatenate(found_q)


def runs_of(codes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least two periods, by start and length, except those below DIRECT periods that are short.

    ``codes`` ends with a barrier, and each barrier is a code of its own.
    """
    names = scales(codes)
    runs = np.concatenate([_direct(codes, q) for q in range(1, min(DIRECT, len(codes) - 1))] or [np.zeros((0, 3), np.int64)])
    runs = _smallest(runs[runs[:, 1] >= np.minimum(LEAST, 4 * runs[:, 2])])
    for k in range(1, len(names) - 1):
        pairs = [np.concatenate(x) for x in zip(_proposed(names, k, runs), _phased(names, k, runs), strict=True)]
        if len(pairs[0]):
            a, q = np.unique(np.stack(pairs, axis=1), axis=0).T
            runs = _smallest(np.concatenate([runs, _checked(names, a, q)]))
    return runs


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row for each stretch: that of the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _searched(texts: list[bytes], least: int) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """(number of words, runs with places inside the text, text without later periods) of each text."""
    split = [t.split() for t in texts]  # bytes are split at ASCII white space
    sizes = list(map(len, split))
    ends = np.cumsum(np.array(sizes, np.int64) + 1)
    codes = np.empty(int(ends[-1]), np.int64)
    n = 0
    for words, end in zip(split, ends.tolist(), strict=True):
        index: dict[bytes, int] = {}
        codes[end - len(words) - 1 : end - 1] = [index.setdefault(w, n + len(index)) for w in words]
        n += len(index)
        codes[end - 1] = n
        n += 1
    runs = runs_of(codes)
    runs = runs[(runs[:, 1] >= least)]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    whose = np.searchsorted(ends, runs[:, 0], side="right")
    cuts = np.searchsorted(whose, np.arange(len(texts) + 1))
    out, kept = [], []
    for k, words in enumerate(split):
        own = runs[cuts[k] : cuts[k + 1]].copy()
        if len(own):
            own[:, 0] -= ends[k] - len(words) - 1
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, own[:, 0] + own[:, 2], 1)
            np.add.at(cover, own[:, 0] + own[:, 1], -1)
            words = [words[j] for j in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]
        out.append(own)
        kept.append(b" ".join(words))
    return sizes, out, kept


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, runs of at least ``least`` words and two periods by start and period, and the text without the words that
    some run holds behind its first period; one row per row, without a shuffle. ``least`` is LEAST or more.
    """
    if least < LEAST:
        raise ValueError(f"runs are found from {LEAST} words on")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])

        def table(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            sizes, runs, kept = _searched(texts, least)
            rows = np.concatenate(runs)
            starts = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
            flat = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists.cast(schema.field("runs").type), pa.array([t.decode() for t in kept], pa.string())], schema=schema)

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                if texts and held + len(raw) > 6 * BLOCK:
                    yield table(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(raw)
                held += len(raw)
            if texts:
                yield table(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``text`` as the contract changes it: in each document whose hash ends in 0 the words from a place on repeat the p words there."""
    (hashed,) = fresh(docs, "_hash")

    def repeated(words: Column) -> Column:
        n, g = F.size(words), F.floor(F.col(hashed) / 10)
        a = F.when(n > 0, g % n).otherwise(0)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p")), lambda s: F.array_join(F.transform(s.w, lambda w, i: F.when(i < s.a, w).otherwise(F.get(s.w, s.a + (i - s.a) % s.p))), " "))

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    changed = F.when((F.col(hashed) % 10 == 0) & F.col("text").isNotNull(), let(words, repeated)).otherwise(F.col("text"))
    return docs.withColumn(hashed, F.crc32(F.col("doc_id").cast("string"))).withColumn("text", changed).drop(hashed)


def digest(found: DataFrame) -> DataFrame:
    """The longest run (of equal ones the first, then that of smallest period), and hashes of all runs and of the text that is left."""
    line = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("fewer"))))
    got = found.withColumn("_best", best)
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.before")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.fewer")).alias("period"),
        F.expr("1000 * _best.length div -_best.fewer").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(line, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, changed as the contract says; the digest columns of their runs."""
    return digest(periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))
