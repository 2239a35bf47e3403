"""Exact groups, boilerplate, and pairs of similar simhashes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import helpers as H
from ..functions import texts as T
from ..functions.dialect import column


def with_simhash(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds simhash, 32 hexadecimal digits."""
    return df.withColumn("simhash", H.simhash(text))


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal content: hash, least key, size. Only hashes are shuffled, and counts combine first."""
    return df.select(F.md5(F.coalesce(text, F.lit(""))).alias("hash"), key).groupBy("hash").agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def host_boilerplate(chunks: DataFrame, least_docs: int = 3) -> DataFrame:
    """Sentences that stand in at least least_docs documents of a host."""
    each = chunks.select("host", "doc_id", F.explode(column(T.sentences, "text")).alias("sentence")).distinct()
    return each.groupBy("host", "sentence").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)


def suppress_boilerplate(chunks: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """(doc_id, text) of every document: its sentences in order without those of its host's boilerplate. Menu-like ones stay; a document of
    boilerplate only, or without text, has the empty text."""
    each = chunks.select("host", "doc_id", F.posexplode_outer(column(T.sentence_parts, "text")).alias("k", "sentence"))
    marked = each.join(boilerplate.select("host", "sentence", F.lit(True).alias("_drop")), ["host", "sentence"], "left")
    kept = F.collect_list(F.when(F.col("_drop").isNull() & (F.col("sentence") != ""), F.struct("k", "sentence")))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(kept), lambda x: x["sentence"]), " ").alias("text"))


def _half(c: str, k: int) -> Column:
    return F.conv(F.substring(c, 16 * k + 1, 16), 16, -10).cast("long")


def hamming(a: str, b: str) -> Column:
    return F.bit_count(_half(a, 0).bitwiseXOR(_half(b, 0))) + F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1)))


def simhash_classes(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, representative) of every row: the least key of its simhash, as in the pairs of near_duplicates.

    Rows of one representative are at distance 0 of each other. Empty texts (all bits unset) stand each for itself.
    """
    # hashes that cannot be null and a condition after the groups: otherwise Spark computes each hash once more to filter
    hashed = df.select(key, F.coalesce("simhash", F.lit("0" * 32)).alias("simhash"))
    least = hashed.groupBy("simhash").agg(F.min(key).alias("_least")).withColumn("_least", F.when(F.col("simhash") != "0" * 32, F.col("_least")))
    return hashed.join(least, "simhash", "left").select(key, F.coalesce("_least", key).alias("representative"))


def near_duplicates(df: DataFrame, max_hamming: int = 3, key: str = "doc_id") -> DataFrame:
    """Pairs of different simhashes within max_hamming bits, as (id of the least row of each), with the rows of equal simhashes as one.

    simhash_classes says which rows each of these ids stands for. A 128-bit hash is cut into bands. Up to distance 3 there are max_hamming + 1
    of them (32 bits each at 3), of which a pair agrees on one; beyond there are max_hamming + 2, of which it agrees on two, and rows meet by twos of
    bands, so that a bucket stays a small part of the table (24 bits or more at distance 7). No pair is missed. Empty
    texts (all bits unset) are left out: they would share every band.
    """
    one = df.where(F.col("simhash") != "0" * 32).groupBy("simhash").agg(F.min(key).alias("id"))
    n = max_hamming + (1 if max_hamming <= 3 else 2)
    cuts = [round(32 * k / n) for k in range(n + 1)]
    band = lambda k: F.substring("simhash", cuts[k] + 1, cuts[k + 1] - cuts[k])
    met_by = [(k,) for k in range(n)] if max_hamming <= 3 else list(combinations(range(n), 2))
    bands = F.explode(F.array(*[F.struct(F.lit(m).alias("band"), F.concat(*map(band, ks)).alias("value")) for m, ks in enumerate(met_by)]))
    keyed = one.select("id", "simhash", bands.alias("b")).select("id", "simhash", "b.band", "b.value")
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.id") < F.col("b.id")) & (hamming("a.simhash", "b.simhash") <= max_hamming))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), hamming("a.simhash", "b.simhash").cast("long").alias("distance")).distinct()


def largest_groups(groups: DataFrame, n: int) -> DataFrame:
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc("copies"), "hash"))).where(F.col("place") <= n)
