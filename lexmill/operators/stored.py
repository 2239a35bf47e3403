"""Q1, stored: the inverted index as a table in buckets of terms, so that a search reads the buckets of its terms only.

``postings`` lies in folders by bucket (a checksum of the term); inside a bucket rows are sorted by term, so row groups
without the terms asked for are passed over. Bucket and a part of the key decide which task writes a row: a term
that most texts hold is spread over FILES tasks. ``size`` is one row: documents, mean length, buckets.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import bm25, build_index, corpus_size, match

BUCKETS, FILES, ROWS_PER_FILE = 64, 8, 5_000_000


def bucket_of(term: str, buckets: int) -> int:
    """As the table has it, where the term is known before the search."""
    return crc32(term.encode()) % buckets


def write_index(texts: DataFrame, path: str, key: str, text: str = "text", stem: bool = False, buckets: int = BUCKETS, files: int = FILES, only: list[int] | None = None) -> None:
    """Builds the index of texts whose key is unique and stores it in place of the one before. With ``only``, these buckets alone are built and replaced (the number of buckets has to stay)."""
    bucket = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(buckets)).cast("int")
    postings = build_index(texts, key, text, stem).withColumn("bucket", bucket)
    if only is not None:
        postings = postings.where(F.col("bucket").isin(only))
    dealt = postings.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(files))).sortWithinPartitions("bucket", "term", key)
    writer = dealt.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("bucket")
    (writer if only is None else writer.option("partitionOverwriteMode", "dynamic")).parquet(f"{path}/postings")
    corpus_size(texts, text).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def read_size(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/size")


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """The postings of the terms, from their buckets; of all terms, if none are named (searches by prefix)."""
    postings = spark.read.parquet(f"{path}/postings")
    if terms:
        buckets = read_size(spark, path).select("buckets").first()[0]
        wanted = sorted({bucket_of(t, buckets) for t in terms})
        postings = postings.where(F.col("bucket").isin(wanted)).where(F.col("term").isin(list(terms)))
    return postings.drop("bucket")


def stored_match(spark: SparkSession, path: str, key: str, all_: list[str] = (), any_: list[str] = (), none: list[str] = (), phrase: list[str] = (), prefix: str = "") -> DataFrame:
    """Q2 from the stored index."""
    terms = [] if prefix else [*all_, *any_, *none, *phrase]
    return match(read_postings(spark, path, terms), key, all_, any_, none, phrase, prefix)


def stored_bm25(spark: SparkSession, path: str, key: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Q3 from the stored index."""
    return bm25(read_postings(spark, path, terms), read_size(spark, path).select("docs", "avg_len"), key, terms, k1, b)
