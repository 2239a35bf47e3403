"""Operator 7, toxicity: cumulative-link ordinal regression over sparse text features.

Severity has GRADES ordered grades. P(grade <= k) = sigmoid(threshold_k - score),
with ordered thresholds and one weight per feature shared by all of them; the
result is the expected severity and the most probable side of the first threshold.

Features are the distinct words of a text and their prefixes (hashed to 64 bits,
so no two share a weight in practice). The labels say only toxic or not, so the
grades of toxic training rows come from the text: the features that toxic rows
have more often than others (by a z-score) are counted, and their rate is cut at its terciles;
rows not toxic have grade 0. Only features with a clear z-score get a
weight, fitted with a penalty by gradient steps.

The fit uses a bounded sample: at most SAMPLE labelled rows, about as many
toxic as not, chosen by a hash of their id; these few rows reach the driver as hashes. Every document is scored, whole, in one
pass without a shuffle.

Null and empty texts have no features, and the base rate as severity; labels
with a null mark are not learned from; equal doc_ids take any label of theirs. Without toxic
labels every severity is 0. Every row gives a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint
from .wordhash import blocks, mix, words

SAMPLE, GRADES, PREFIX = 6000, 4, 5
LEAST_Z, LEAST_ROWS = 4.0, 4
STEPS, RATE, PENALTY = 400, 0.5, 1e-3
SCHEMA = "doc_id long, severity double, grade int, toxic boolean"


def features(offsets: np.ndarray, raw: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct features of each text."""
    whole, first = words(offsets, raw, letters=True)
    short, _ = words(offsets, raw, prefix=PREFIX, letters=True)
    short = mix(short ^ np.uint64(0x5BF03635)) if len(short) else short
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(np.concatenate((whole[a:b], short[a:b])))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.keys, self.weights, self.thresholds = keys, weights, thresholds

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not len(self.keys) or not rows:
            return np.zeros(len(rows))
        all_keys = np.concatenate(rows)
        at = np.minimum(np.searchsorted(self.keys, all_keys), len(self.keys) - 1)
        gains = np.where(self.keys[at] == all_keys, self.weights[at], 0.0)
        return np.bincount(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), gains, len(rows))

    def severity(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, most probable grade by the median)."""
        above = 1 - _sigmoid(self.thresholds[None, :] - self.scores(rows)[:, None])
        return above.sum(axis=1), (above > 0.5).sum(axis=1)


def fit(rows: list[np.ndarray], toxic: np.ndarray, grades: int = GRADES) -> Model:
    """Cumulative logits by proximal gradient steps on the features that tell."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, 40.0))
    n1 = int(toxic.sum())
    n0 = len(rows) - n1
    if not n1 or not n0:
        return none
    line = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    keys, code = np.unique(np.concatenate(rows), return_inverse=True)
    in1 = np.bincount(code, toxic[line], len(keys))
    in0 = np.bincount(code, ~toxic[line], len(keys))
    share = (in1 + in0) / len(rows)
    z = (in1 / n1 - in0 / n0) / np.sqrt(np.maximum(share * (1 - share) * (1 / n1 + 1 / n0), 1e-12))
    used = (np.abs(z) >= LEAST_Z) & (in1 + in0 >= LEAST_ROWS)
    if not used.any():
        return none
    column = np.cumsum(used) - 1
    kept = used[code]
    line, col = line[kept], column[code[kept]]
    signs = np.bincount(line, (z[used] > 0)[col], len(rows)) / np.array([max(1, len(r)) for r in rows])
    cuts = np.quantile(signs[toxic], [k / (grades - 1) for k in range(1, grades - 1)])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, signs, side="left"), 0)
    n_columns, w = int(used.sum()), np.zeros(int(used.sum()))
    thresholds = np.array([np.log(max((grade <= k).sum(), 1) / max((grade > k).sum(), 1)) for k in range(grades - 1)])
    size = np.sqrt(np.bincount(col, minlength=n_columns) / len(rows) + 1e-4)  # steps by a feature's frequency
    for _ in range(STEPS):
        s = np.bincount(line, w[col], len(rows))
        upper = np.append(thresholds, np.inf)[grade] - s
        lower = np.append(-np.inf, thresholds)[grade] - s
        f, g = _sigmoid(upper), np.where(np.isinf(lower), 0.0, _sigmoid(lower))
        f = np.where(np.isinf(upper), 1.0, f)
        p = np.maximum(f - g, 1e-9)
        du, dl = f * (1 - f) / p, g * (1 - g) / p
        slope = du - dl  # of the loss, by the score
        move = np.bincount(col, slope[line], n_columns) / len(rows)
        w -= RATE * move / size
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * PENALTY, 0)
        for k in range(grades - 1):
            thresholds[k] -= RATE * (dl[grade == k + 1].sum() - du[grade == k].sum()) / len(rows)
        thresholds = np.maximum.accumulate(thresholds)
    return Model(keys[used], w, thresholds)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    marked = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return fit([], np.zeros(0, bool))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    share = {k: int(min(1.0, 0.45 * sample / n) * (1 << 30)) for k, n in counts.items()}
    drawn = marked.where(draw < F.when(F.col("toxic") > 0, share[True]).otherwise(share[False]))
    # about nine tenths of ``sample`` rows, by half toxic where there are as many; the limit makes it sure: safe to broadcast
    chosen = checkpoint(drawn.orderBy(draw, "doc_id").limit(sample).dropDuplicates(["doc_id"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, raw in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), batch.column("toxic").slice(first, last - first), pa.array([f.tobytes() for f in features(offsets, raw)], pa.binary())], ["doc_id", "toxic", "features"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    got = sorted(joined.mapInArrow(run, "doc_id long, toxic int, features binary").collect(), key=lambda r: (r["doc_id"], r["features"]))
    return fit([np.frombuffer(r["features"], np.uint64) for r in got], np.array([r["toxic"] > 0 for r in got], bool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, severity, grade, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, raw in blocks(batch.column("text")):
                severity, grade = shared.value.severity(list(features(offsets, raw)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first).cast(pa.int64()), pa.array(severity, pa.float64()), pa.array(grade.astype(np.int32)), pa.array(grade > 0)], ["doc_id", "severity", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
