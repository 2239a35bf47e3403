"""Revisions, changes, diffs and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import helpers as H
from ..functions import rules as R
from .joins import match_root


def resolve_columns(df: DataFrame) -> DataFrame:
    """Renames columns by role: a preferred name first, then a pattern; hashes at last from two columns that contain 'hash'. Raises without url and both hashes."""
    import re

    left, found = list(df.columns), {}
    for role, (preferred, pattern) in R.COLUMN_ROLES.items():
        named = [c for c in left if c.lower() in (role, preferred)] or sorted(c for c in left if re.search(pattern, c, re.I))
        if named:
            found[role] = named[0]
            left.remove(named[0])
    if not {"prev_hash", "new_hash"} <= found.keys():
        hashes = sorted(c for c in [*left, *(found[r] for r in ("prev_hash", "new_hash") if r in found)] if "hash" in c.lower())
        if len(hashes) >= 2:
            found["prev_hash"], found["new_hash"] = hashes[0], hashes[1]
    if lacking := {"url", "prev_hash", "new_hash"} - found.keys():
        raise ValueError(f"no column for {', '.join(sorted(lacking))} in {df.columns}")
    return df.select(*[F.col(c).alias(role) for role, c in found.items()])


def revision_pairs(revs: DataFrame) -> DataFrame:
    """Each revision with the hash before it, where they differ; ordered by time, then id. Hashes only, so that texts stay out of the window's shuffle."""
    order = Window.partitionBy("url").orderBy("created_at", "id")
    slim = revs.select("id", "url", "created_at", "content_hash")
    pairs = slim.withColumns({"prev_hash": F.lag("content_hash").over(order), "prev_id": F.lag("id").over(order)})
    changed = pairs.where("prev_hash IS NOT NULL AND NOT (prev_hash <=> content_hash)")
    return changed.select("id", "prev_id", "url", "created_at", "prev_hash", F.col("content_hash").alias("new_hash"), F.lit("backfill").alias("kind"))


def capture_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, content_hash, clean_text, body) before and after: one row per URL whose hash differs."""
    text = lambda: F.coalesce(F.nullif("clean_text", F.lit("")), "body", F.lit(""))
    a = old.select("url", F.col("content_hash").alias("prev_hash"), text().alias("prev_text"))
    b = new.select("url", F.col("content_hash").alias("new_hash"), text().alias("new_text"))
    differs = F.coalesce("prev_hash", F.lit("")) != F.coalesce("new_hash", F.lit(""))
    return a.join(b, "url").where(differs).withColumn("kind", F.lit("content_hash_changed"))


def detect_changes(revs: DataFrame, n: int = 50) -> DataFrame:
    """The newest n changes; texts are joined and compared for those only."""
    pairs = revision_pairs(revs).orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    body = lambda side, name: revs.select(F.col("id").alias(side), F.col("body").alias(name))
    both = pairs.join(body("id", "new_text"), "id").join(body("prev_id", "prev_text"), "prev_id")
    short = lambda c: F.substring(c, 1, 12)
    return both.select("url", F.col("created_at").alias("changed_at"), F.col("kind").alias("change_kind"), short("prev_hash").alias("prev_hash"), short("new_hash").alias("new_hash"), H.tiny_diff("prev_text", "new_text").alias("short_diff"))


def change_records(pairs: DataFrame) -> DataFrame:
    """Url, old and new text -> a unified diff, and whether the change is material (any changed line)."""
    return pairs.withColumn("diff", H.line_diff("prev_text", "new_text")).withColumn("material_changes", F.col("diff") != "")


def changes_since(revs: DataFrame, now: str, interval: str, n: int = 50) -> DataFrame:
    """Revisions not older than now - interval, newest first, with a preview."""
    return revs.where(F.expr(f"created_at >= TIMESTAMP '{now}' - INTERVAL {interval}")).orderBy(F.desc("created_at"), F.desc("id")).limit(n).select("id", "url", "created_at", F.substring("body", 1, 120).alias("preview"))


def alert_changes(changes: DataFrame, watched: DataFrame, tagged: DataFrame, tags: list[str], now: str, hours: int) -> DataFrame:
    """Recent changes of watched hosts (host) and those under them, of URLs with any watched tag (tagged: url, tag)."""
    recent = changes.where(F.expr(f"created_at >= TIMESTAMP '{now}' - INTERVAL {hours} HOURS"))
    hosted = match_root(recent, watched.select(F.col("host").alias("root"))).where("root IS NOT NULL")
    return hosted.join(tagged.where(F.col("tag").isin(tags)).select("url").distinct(), "url", "left_semi")
