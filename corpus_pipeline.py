"""The corpus pipeline: language ID, near duplicates, secret scans, mixing and packing, each on what the stage before kept.

Other columns, whatever their names, go through the first four stages as they are. Empty tables give empty tables.
Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's documents. All but the last return
the columns of documents.

- language_id drops documents in which no language is found (``und``: null texts and texts without a letter) and
  sets ``lang`` to the language found where it is missing.
- near_duplicates keeps, of each group of documents linked by 4-word shingles, the one with the least doc_id. Rows that
  share a doc_id, or have none, are documents of their own: they stay unless they link with another row, and go before rows with an id of their own.
- secret_scan replaces every secret, also inside decoded layers, and counts n_chars again.
- mix selects documents to the target weights, each at most once, within MIX_PERCENT of the tokens.
- pack cuts and packs the rest into training sequences, one row per piece.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import language_id as languages
from lexmill.llm import mixing, ngram_join, packing, secret_scan
from lexmill.llm.shared import fresh, shared_folder, small_or_as_is, written

MIX_PERCENT = 90
#: Row numbers begin here where a doc_id is null or shared; ids are below.
UNNUMBERED = 1 << 62
#: Bytes of words that a worker of the packing stage keeps; stages before it leave the heap of an executor grown.
CACHED_BYTES = 24 << 20


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, score = fresh(docs, "lang_pred", "score")
    named = languages.with_language(docs, languages.learn(docs), (found, score))
    kept = named.where(F.col(found) != languages.UNKNOWN).withColumn("lang", F.coalesce("lang", found))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (row,) = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.col("doc_id").cast("long"))
    shared = written(docs.groupBy("doc_id").count().where("doc_id is null or count > 1").select("doc_id"))
    if shared.take(1):
        # rows without an id of their own get a number each, above all ids; it is written, so it stays
        same = F.col("doc_id").eqNullSafe(F.col("_shared"))
        ids = small_or_as_is(shared.select(F.col("doc_id").alias("_shared")))
        others = written(numbered.join(ids, same, "left_semi").withColumn(row, F.monotonically_increasing_id() + F.lit(UNNUMBERED)))
        numbered = numbered.join(ids, same, "left_anti").unionByName(others)
    grouped = written(ngram_join.ngram_components(numbered.select(F.col(row).alias("doc_id"), "text")))
    extra = written(grouped.where("doc_id > component_id").select(F.col("doc_id").alias(row)).distinct())
    return numbered.join(small_or_as_is(extra), row, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select(docs, max_epochs=1, percent=MIX_PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached=CACHED_BYTES))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix", mix),
    ("pack", pack),
]

#: Cross-parsing and decoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
