"""Joins of documents, queue, chunks, policies and roots; and row filters that need them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import helpers as H
from ..functions import rules as R
from ..functions import texts as T
from ..functions import urls as U
from ..functions.dialect import SPARK, column


def sanitized_urls(df: DataFrame, url: str = "url", out: str = "clean") -> DataFrame:
    """Adds the URL with every entity resolved and its tail cleaned."""
    return H.with_unescaped(df, {out: F.coalesce(F.col(url), F.lit(""))}).withColumn(out, column(U.after_entities, out))


def keep_urls(df: DataFrame, url: str, root: str, out: str = "keep") -> DataFrame:
    """adds whether the sieve keeps a URL: one with a web scheme, sanitised, found from a root host."""
    clean = sanitized_urls(df, url, "_clean")
    web = F.coalesce(F.col(url).rlike("(?i)^https?://"), F.lit(False))
    return clean.withColumn(out, web & column(U.keep_url, "_clean", root)).drop("_clean")


def hits_with_documents(hits: DataFrame, docs: DataFrame, key: str = "url") -> DataFrame:
    """J1."""
    return hits.join(docs, key)


def docs_with_queue(docs: DataFrame, queue: DataFrame) -> DataFrame:
    """J2."""
    return docs.join(queue.select("url", F.col("status").alias("q_status")), "url", "left")


def docs_without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """An anti-join on non-null keys, so no null-aware plan."""
    return docs.join(chunks.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti")


def untagged_chunks(chunks: DataFrame, chunk_tags: DataFrame) -> DataFrame:
    """J3."""
    return chunks.join(chunk_tags.select("chunk_id").distinct(), "chunk_id", "left_anti")


def queue_backfill(queue: DataFrame, docs: DataFrame) -> DataFrame:
    """Queue rows whose URL is a document become hydrated."""
    have = docs.where("url IS NOT NULL").select("url").distinct().withColumn("_have", F.lit(True))
    return queue.join(have, "url", "left").withColumn("status", F.when(F.col("_have"), "hydrated").otherwise(F.col("status"))).drop("_have")


def queue_backfill_counts(queue: DataFrame, docs: DataFrame) -> DataFrame:
    return queue_backfill(queue, docs).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "hydrated").alias("hydrated"), F.count_if(F.col("status").isin("pending", "queued") | (F.col("status") == "")).alias("pending"))


def counts_by_seed(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds (url) keep their zeros."""
    domain = column(U.host_of, "url", strip_www=True, with_port=False)
    counts = docs.groupBy(domain.alias("domain")).agg(F.count("*").alias("count"))
    return seeds.select(domain.alias("domain")).distinct().join(counts, "domain", "left").select("domain", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def with_policy(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Each row with its host's policy, by host, then alias, else the ``default`` row. The policy table is a few rows of configuration."""
    rows = policies.select("host", F.explode(F.array_union(F.array("host"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name"), F.struct(*policies.columns).alias("_policy"))
    named = rows.where("host <> 'default'").groupBy("_name").agg(F.min_by("_policy", F.concat(F.when(F.col("_name") == F.col("host"), "0").otherwise("1"), F.col("host"))).alias("_policy"))
    default = policies.where("host = 'default'").select(F.struct(*policies.columns).alias("_default")).limit(1)
    hosted = df.withColumn("_name", column(U.host_of, "url", with_port=False)).join(F.broadcast(named), "_name", "left").join(F.broadcast(default), how="left", on=F.lit(True))
    return hosted.withColumn("policy", F.coalesce("_policy", "_default")).drop("_name", "_policy", "_default")


def normalized_by_policy(df: DataFrame, policies: DataFrame, enforce: bool = True) -> DataFrame:
    """Adds canonical_url; with enforcement off URLs stay as they are."""
    if not enforce:
        return with_policy(df, policies).withColumn("canonical_url", F.col("url"))
    rule = column(U.policy_url, "url", "policy.collapse_www", "policy.strip_ports", "policy.drop_fragments", "policy.strip_params")
    return with_policy(df, policies).withColumn("canonical_url", rule)


def allowed_by_policy_path(df: DataFrame, policies: DataFrame) -> DataFrame:
    """adds allowed: some allowed prefix (if any are listed), and no denied pattern."""
    joined = with_policy(df, policies).withColumn("_path", F.expr(f"CASE WHEN {U.path(SPARK, 'url')} = '' THEN '/' ELSE {U.path(SPARK, 'url')} END"))
    allow = (F.size("policy.allow_prefixes") == 0) | F.exists("policy.allow_prefixes", lambda p: F.col("_path").startswith(p))
    deny = F.exists("policy.deny_patterns", lambda p: F.expr("1") == F.when(F.regexp_like(F.col("_path"), p), 1))
    return joined.withColumn("allowed", allow & ~F.coalesce(deny, F.lit(False))).drop("_path")


def render_by_policy(docs: DataFrame, policies: DataFrame, statuses: tuple[int, ...] = (401, 403, 406, 429), min_html: int = 1800) -> DataFrame:
    """U16 with J6: adds needs_render. A policy's statuses stand in for the usual ones; a page that passes is asked for its policy's least length, or else its greatest share of script tags."""
    status = F.col("status_code")
    own = F.col("policy.hydration.render_on_status")
    asked = F.when(F.size(F.coalesce(own, F.array().cast("array<int>"))) > 0, F.array_contains(own, status)).otherwise(status.isin(*statuses))
    length = F.length(F.coalesce("body", F.lit("")))
    thin, over = F.coalesce(F.col("policy.hydration.thin_html_min_text_chars"), F.lit(0)), F.col("policy.hydration.script_ratio_over")
    share = F.expr(T.render_flags(SPARK, "status_code", "coalesce(body, '')", "''")["script_ratio"])
    by_policy = F.when(thin > 0, (length < thin) | F.coalesce(share > over, F.lit(False))).otherwise(F.coalesce(share > over, F.lit(False)))
    return with_policy(docs, policies).withColumn("needs_render", F.coalesce(asked, F.lit(False)) | (length < min_html) | by_policy)


def match_root(df: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest root (root) that is the host or a parent of it. Resolved once for each distinct host: its parents (a handful) are
    exploded into an equi-join, and rows meet the result by host."""
    labels = F.split("_host", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosted = df.withColumn("_host", column(U.host_of, "url", with_port=False))
    asked = hosted.select("_host").where("_host IS NOT NULL").distinct()
    found = asked.select("_host", F.explode(parents).alias("root")).join(roots.select("root").distinct(), "root").groupBy("_host").agg(F.max_by("root", F.length("root")).alias("root"))
    return hosted.join(found, "_host", "left").select(*df.columns, "root")


def strict_prune(df: DataFrame, roots: DataFrame) -> DataFrame:
    """adds root and reason (null: kept)."""
    matched = match_root(df, roots)
    host = column(U.host_of, "url", with_port=False)
    label = F.when(host == F.col("root"), "").otherwise(F.expr(f"substr({U.host_of(SPARK, 'url', with_port=False)}, 1, length({U.host_of(SPARK, 'url', with_port=False)}) - length(root) - 1)"))
    rest = F.concat(column(U.path, "url"), F.when(column(U.query, "url") != "", F.concat(F.lit("?"), column(U.query, "url"))).otherwise(""))
    reason = F.when(F.col("root").isNull(), "no-root").when(~label.isin("", *R.ALLOWED_LABELS), "host").when(rest.rlike(R.PRUNE_DENY), "deny-hint").when(~rest.rlike(R.PRUNE_ALLOW), "no-allow-hint")
    return matched.withColumn("reason", reason)


def purge_junk(docs: DataFrame, hosts: list[str] | None = None, like: str | None = None, status: list[int] | None = None, zero_clean: bool = False, zero_body: bool = False) -> DataFrame:
    """adds purge: all given conditions hold; without any: status 404 or 410, or no clean text."""
    tests = []
    if hosts:
        tests.append(column(U.host_of, "url", with_port=False).isin(hosts))
    if like:
        tests.append(F.col("url").ilike(like))
    if status:
        tests.append(F.coalesce(F.col("status_code").isin(status), F.lit(False)))
    if zero_clean:
        tests.append(F.length(F.coalesce("clean_text", F.lit(""))) == 0)
    if zero_body:
        tests.append(F.length(F.coalesce("body", F.lit(""))) == 0)
    if not tests:
        tests = [F.coalesce(F.col("status_code").isin(404, 410), F.lit(False)) | (F.length(F.coalesce("clean_text", F.lit(""))) == 0)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return docs.withColumn("purge", out)


def purge_queue(queue: DataFrame, docs: DataFrame, hosts: list[str]) -> DataFrame:
    """queue rows of the hosts that are not documents."""
    return queue.where(column(U.host_of, "url", with_port=False).isin(hosts)).join(docs.select("url").distinct(), "url", "left_anti")


def fetch_candidates(docs: DataFrame, mode: str = "smart", n: int | None = None, contains: str = "", domain: str = "") -> DataFrame:
    """what to fetch next, oldest first."""
    if mode == "smart":
        test = F.expr("fetched_at IS NULL OR coalesce(body, '') = '' OR coalesce(status_code, 0) NOT IN (200, 304) OR coalesce(last_error, '') <> ''")
    elif mode == "contains":
        test = F.col("url").contains(contains) | F.coalesce("title", F.lit("")).contains(contains)
    else:
        test = (column(U.host_of, "url", with_port=False) == domain) & F.expr("coalesce(body, '') = ''")
    found = docs.where(test).orderBy(F.asc_nulls_first("fetched_at"), "url", "id")
    return found.limit(n) if n else found


def search_by_tag(chunk_tags: DataFrame, chunks: DataFrame, tag: str, n: int | None = None) -> DataFrame:
    """Chunks of a tag with a preview of 260 characters."""
    found = chunk_tags.where(F.col("tag") == tag).join(chunks, "chunk_id").select("chunk_id", "score", F.substring("text", 1, 260).alias("preview"))
    return found.orderBy(F.desc("score"), "chunk_id").limit(n) if n else found


def suffix_join(df: DataFrame, watched: DataFrame) -> DataFrame:
    """Rows whose host is a watched host (host) or under one."""
    roots = watched.select(F.col("host").alias("root"))
    return match_root(df, roots).where("root IS NOT NULL")
