"""Table maintenance as DataFrame jobs: inserts, overwrites, canonical merges, ordered unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..llm.shared import written


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key. ``row_number`` with a limit of 1 is cut down before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def insert_ignore(target: DataFrame, new: DataFrame, key: str, *order) -> DataFrame:
    """M1: target and those of the new rows whose key it lacks; the first of equal new keys."""
    fresh = first_per(new.where(F.col(key).isNotNull()), [key], *order).join(target.select(key).distinct(), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def upsert_overwrite(target: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """M2: new keys are added; of known ones only the listed columns change."""
    n = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key], F.lit(True).alias("_new"))
    both = target.withColumn("_old", F.lit(True)).join(n, F.col(key) == F.col("_key"), "full")
    value = lambda c: F.when(F.col("_new") & (F.col("_old").isNull() | F.lit(c in columns)), F.col(f"_n_{c}")).otherwise(F.col(c)) if c in new.columns else F.col(c)
    return both.select(F.coalesce(key, "_key").alias(key), *[value(c).alias(c) for c in target.columns if c != key])


def upsert_with_revision(target: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """M3: as M2 for title, body and content_hash; a null title keeps the old one; revisions counts changes between two known hashes."""
    n = new.select(F.col(key).alias("_key"), F.col("title").alias("_t"), F.col("body").alias("_b"), F.col("content_hash").alias("_h"), F.lit(True).alias("_new"))
    both = target.join(n, F.col(key) == F.col("_key"), "full")
    changed = F.coalesce(F.col("content_hash") != F.col("_h"), F.lit(False))
    took = F.col("_new").isNotNull()
    return both.select(
        F.coalesce(key, "_key").alias(key),
        F.coalesce("_t", "title", F.lit("")).alias("title"),
        F.when(took, F.col("_b")).otherwise(F.col("body")).alias("body"),
        F.when(took, F.col("_h")).otherwise(F.col("content_hash")).alias("content_hash"),
        (F.coalesce("revisions", F.lit(0)) + F.when(took & changed, 1).otherwise(0)).cast("long").alias("revisions"),
    )


def canonical_winners(docs: DataFrame) -> DataFrame:
    """Docs with canonical_url -> the winning row of each canonical URL: one already there, else by good status, body length, time.

    The body stays out of the shuffle: only its length, the status and the time are compared.
    """
    slim = docs.select("id", "url", "canonical_url", (F.col("url") == F.col("canonical_url")).alias("there"), F.coalesce(F.col("status_code").isin(200, 304), F.lit(False)).alias("good"), F.length(F.coalesce("body", F.lit(""))).alias("size"), F.coalesce(F.unix_timestamp("fetched_at"), F.lit(0)).alias("at"))
    best = slim.groupBy("canonical_url").agg(F.max_by(F.struct("id", "url"), F.struct("there", "good", "size", "at", (-F.col("id")).alias("first"))).alias("w"), F.count("*").alias("members"))
    return best.select("canonical_url", F.col("w.id").alias("id"), F.col("w.url").alias("url"), "members")


def canonicalize_merge(docs: DataFrame) -> DataFrame:
    """M4: the winners' rows under their canonical URL."""
    return docs.drop("url", "canonical_url").join(canonical_winners(docs).select("id", F.col("canonical_url").alias("url")), "id")


def merge_report(docs: DataFrame) -> DataFrame:
    """M4: groups, URLs that change, rows renamed and rows deleted."""
    groups = canonical_winners(docs)
    counts = docs.agg(F.count("*").alias("docs"), F.count_if(F.col("url") != F.col("canonical_url")).alias("changed"))
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("url") != F.col("canonical_url")).alias("updated"), F.sum(F.col("members") - 1).alias("deleted")).crossJoin(F.broadcast(counts))


def collapse_queue(queue: DataFrame) -> DataFrame:
    """M4: queue rows with canonical_url become one: hydrated if any is, else the first status that is not empty, else queued."""
    said = F.when(F.coalesce("status", F.lit("")) != "", F.col("status"))
    out = queue.groupBy("canonical_url").agg(F.max((F.col("status") == "hydrated").cast("int")).alias("h"), F.min_by(said, F.when(said.isNotNull(), F.col("queue_id"))).alias("s"))
    return out.select(F.col("canonical_url").alias("url"), F.when(F.col("h") == 1, "hydrated").otherwise(F.coalesce("s", F.lit("queued"))).alias("status"))


def apply_fetch_results(docs: DataFrame, fetches: DataFrame) -> DataFrame:
    """M5: fetches (url, code, new_body, rendered, asset, at) set the documents' state. An empty body of code 200 is stored, but the queue goes on waiting;
    a page that was rendered after a 429 or 503 keeps that as its last error."""
    j = docs.join(fetches, "url", "left")
    code, body = F.col("code"), F.coalesce("new_body", F.lit(""))
    rendered = F.coalesce("rendered", F.lit(False))
    eff = F.when(rendered & (code.isin(0, 401, 403, 406, 429) | (F.length(body) > 0)), 200).otherwise(code)
    new_hash = F.when(eff == 200, F.md5(body))
    outcome = F.when(code.isNull() & ~F.coalesce("asset", F.lit(False)), "none").when(F.coalesce("asset", F.lit(False)), "skipped-asset").when(code == 304, "not-modified").when((eff == 200) & (new_hash == F.col("content_hash")), "unchanged").when(eff == 200, "fetched").when(code == 0, "network-error").when(code.isin(429, 503), F.concat(F.lit("http-"), code)).otherwise("bad-status")
    o = F.col("outcome")
    moved = o.isin("fetched", "network-error", "http-429", "http-503", "bad-status")
    return j.withColumns({"outcome": outcome, "_eff": eff, "_hash": new_hash}).select(
        "id",
        "url",
        "outcome",
        F.when(o == "skipped-asset", 0).when(o == "not-modified", 304).when(moved, F.col("_eff")).otherwise(F.col("status_code")).cast("int").alias("status_code"),
        F.when(o == "fetched", body).when(moved, "").otherwise(F.col("body")).alias("body"),
        F.when(moved, "").otherwise(F.col("clean_text")).alias("clean_text"),
        F.when(moved, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        (F.col("retry_count") + F.when((o == "skipped-asset") | (moved & (o != "fetched")), 1).otherwise(0)).cast("long").alias("retry_count"),
        F.when(o == "skipped-asset", "skipped-asset").when(o.isin("network-error", "http-429", "http-503"), o).when((o == "fetched") & code.isin(429, 503), F.concat(F.lit("http-"), code)).when(moved | (o == "not-modified"), F.lit(None)).otherwise(F.col("last_error")).alias("last_error"),
        F.when(o.isin("skipped-asset", "not-modified", "unchanged") | ((o == "fetched") & (body != "")), "hydrated").alias("queue_status"),
    )


def build_tag_dictionary(doc_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: (tag_id, tag) and the unique links (doc_id, tag_id). Ids number the distinct tags in order: they are sorted by ranges, and each range
    goes on from the size of those before it, so no task sees all tags. The tags are found once and written, as they are read three times."""
    doc_tags = written(doc_tags)
    tags = doc_tags.select("tag").where("tag IS NOT NULL").distinct().orderBy("tag")
    ids = tags.rdd.map(lambda r: r["tag"]).zipWithIndex().map(lambda x: (x[1] + 1, x[0])).toDF("tag_id long, tag string")
    return ids, doc_tags.join(ids, "tag").select("doc_id", "tag_id").distinct()


def union_keep_first(*frames: DataFrame, key: str = "url", order: str = "id") -> DataFrame:
    """The first row of each key, by frame, then by order."""
    numbered = [f.withColumn("_frame", F.lit(k)) for k, f in enumerate(frames)]
    return first_per(reduce(DataFrame.unionByName, numbered), [key], "_frame", order).drop("_frame")


def except_urls(df: DataFrame, drop: DataFrame) -> DataFrame:
    """X2."""
    return df.join(drop.select("url").where("url IS NOT NULL").distinct(), "url", "left_anti")


def top_per(df: DataFrame, key: str, cap: int, n: int | None, *order) -> DataFrame:
    """At most cap rows per key, then the n first of all (None: all of them, in no order)."""
    kept = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= cap).drop("_k")
    return kept if n is None else kept.orderBy(*order).limit(n)
