"""Streaming forms: change capture, enqueueing, host activity, alerts, and the stateless cleaning chain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunking import chunk_sliding
from ..operators.html import smart_clean
from ..operators.tagging import tag_chunks


class _LastHash(StatefulProcessor):
    """Keeps a URL's last hash and its revisions, for ``ttl_ms`` after they last changed (0: for good); emits a row when the hash changes."""

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, revisions long", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get() if self.last.exists() else None
        hash_, revisions = (known[0], known[1]) if known else (None, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["created_at", "id"]).itertuples():
            if hash_ is not None and r.content_hash is not None and r.content_hash != hash_:
                revisions += 1
                out.append((r.id, key[0], r.created_at, hash_, r.content_hash, revisions))
            hash_ = r.content_hash if r.content_hash is not None else hash_
        self.last.update((hash_, revisions))
        yield pd.DataFrame(out, columns=["id", "url", "created_at", "prev_hash", "new_hash", "revision"])

    def close(self) -> None:
        pass


#: What value state needs (set it before the stream starts): the state store, and no batches without data, with which a stream whose state has a time to live never ends by itself.
ROCKSDB = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CHANGES = "id long, url string, created_at timestamp, prev_hash string, new_hash string, revision long"


def stream_changes(fetches: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """ST1: (id, url, created_at, content_hash) -> a row per change. State is a hash and a count per URL, given up ``ttl_ms`` of processing time after its last
    observation (0: never; a URL seen again then begins anew); needs the RocksDB state store (``ROCKSDB``)."""
    return fetches.select("id", "url", "created_at", "content_hash").groupBy("url").transformWithStateInPandas(_LastHash(ttl_ms), CHANGES, "Append", "ProcessingTime" if ttl_ms else "None")


def stream_changes_grouped(fetches: DataFrame) -> DataFrame:
    """ST1 on state stores without the newer state API: the same with applyInPandasWithState."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hash_, revisions = state.get if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["created_at", "id"]).itertuples():
            if hash_ is not None and r.content_hash is not None and r.content_hash != hash_:
                revisions += 1
                out.append((r.id, key[0], r.created_at, hash_, r.content_hash, revisions))
            hash_ = r.content_hash if r.content_hash is not None else hash_
        state.update((hash_, revisions))
        yield pd.DataFrame(out, columns=["id", "url", "created_at", "prev_hash", "new_hash", "revision"])

    slim = fetches.select("id", "url", "created_at", "content_hash")
    return slim.groupBy("url").applyInPandasWithState(step, CHANGES, "hash string, revisions long", "append", GroupStateTimeout.NoTimeout)


def stream_enqueue(urls: DataFrame, horizon: str = "1 day", time: str = "created_at") -> DataFrame:
    """ST2: the first row of each URL within the horizon."""
    return urls.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["url"])


def stream_host_activity(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """ST3: (host, created_at, kind) -> windowed counts of all, hydrated and error rows."""
    span = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    return events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).groupBy(span.alias("w"), "host").agg(F.count("*").alias("fetched"), F.count_if(F.col("kind") != "error").alias("hydrated"), F.count_if(F.col("kind") == "error").alias("errors")).select(F.col("w.start").alias("start"), "host", "fetched", "hydrated", "errors")


def _parents(host: Column) -> Column:
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def stream_alerts(changes: DataFrame, watched: DataFrame, tagged: DataFrame, tags: list[str], hours: int | None = None) -> DataFrame:
    """ST4: changes of watched hosts, and of those under them, whose URL has a watched tag, as J8 over a batch: stream-static joins, without state.

    The host's parents are exploded into the join; of nested watched hosts the longest counts: each watched host carries the watched ones under it (found once, on the
    static side), and a change of one of those is not its own. With ``hours``, only changes at most so old when their batch is read.
    """
    urls = tagged.where(F.col("tag").isin(tags)).select("url").distinct()
    hosts = watched.select(F.lower(F.trim("host")).alias("root")).where("root <> ''").distinct()
    nested = hosts.select(F.col("root").alias("_under"), F.explode(_parents(F.col("root"))).alias("root")).where("root <> _under").groupBy("root").agg(F.collect_set("_under").alias("_nested"))
    hosts = hosts.join(nested, "root", "left")
    if hours is not None:
        changes = changes.where(F.col("created_at").cast("timestamp") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(hours)))
    hosted = changes.join(urls, "url", "left_semi").withColumn("_host", F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/:?#]*)", 1)))
    met = hosted.withColumn("root", F.explode(_parents(F.col("_host")))).join(hosts, "root")
    closer = F.exists("_nested", lambda h: (F.col("_host") == h) | F.endswith(F.col("_host"), F.concat(F.lit("."), h)))
    return met.where(~F.coalesce(closer, F.lit(False))).select(*changes.columns, "root")


def stream_clean_chunk_tag(pages: DataFrame) -> DataFrame:
    """ST5: (id, url, host, body) -> tags of chunks; stateless, so it runs on streams and batches alike, and a stream resumes after its last committed files."""
    cleaned = smart_clean(pages).select(F.col("id").alias("doc_id"), "url", "host", F.col("clean_text").alias("text"))
    chunks = chunk_sliding(cleaned).withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    return tag_chunks(chunks)
