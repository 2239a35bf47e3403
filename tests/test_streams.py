"""Streams against their batch forms: value state and its time to live, restarts, nested hosts and the age of alerts."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.operators import changes
from lexmill.streaming import streams

FETCHES = "id long, url string, created_at timestamp, content_hash string"


@pytest.fixture()
def rocksdb(spark):
    for k, v in streams.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k in streams.ROCKSDB:
        spark.conf.unset(k)


def _run(stream, folder, mode="append"):
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def _fetches(n, first=0):
    begin = datetime(2024, 1, 1)
    return [(first + k, f"https://a/{k % 5}", begin + timedelta(minutes=first + k), None if k % 11 == 0 else f"h{(first + k) // 5 % 3}") for k in range(n)]


def _add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_value_state_equals_the_batch_over_two_runs(spark, tmp_path, rocksdb):
    rows = _fetches(60)
    for part in (rows[:33], rows[33:]):
        _add(spark, tmp_path / "in", part, FETCHES)
        _run(streams.stream_changes(spark.readStream.schema(FETCHES).parquet(str(tmp_path / "in"))), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    known = spark.createDataFrame([r for r in rows if r[3]], FETCHES)  # a fetch without a hash leaves the last one
    want = changes.revision_pairs(known).select("id", "url", "prev_hash", "new_hash")
    assert sorted(map(tuple, got.select("id", "url", "prev_hash", "new_hash").collect())) == sorted(map(tuple, want.collect()))
    last = {r.url: r.revision for r in got.groupBy("url").agg(F.max("revision").alias("revision")).collect()}
    assert last == {r.url: r["count"] for r in want.groupBy("url").count().collect()}


def test_state_is_gone_after_its_time(spark, tmp_path, rocksdb):
    stream = lambda ttl, name: streams.stream_changes(spark.readStream.schema(FETCHES).parquet(str(tmp_path / "in")), ttl)
    at = datetime(2024, 1, 1)
    _add(spark, tmp_path / "in", [(1, "u", at, "a")], FETCHES)
    for ttl, name in ((1000, "short"), (3_600_000, "long")):
        _run(stream(ttl, name), tmp_path / name)
    time.sleep(1.5)
    _add(spark, tmp_path / "in", [(2, "u", at, "b")], FETCHES)
    for ttl, name in ((1000, "short"), (3_600_000, "long")):
        _run(stream(ttl, name), tmp_path / name)
    count = lambda name: spark.read.schema(streams.CHANGES).parquet(f"{tmp_path}/{name}/out").count()
    assert (count("short"), count("long")) == (0, 1)


PAGES = "id long, url string, host string, body string"


def test_a_stopped_stream_resumes_with_new_files(spark, tmp_path):
    text = "<p>" + "We transfer data outside the EEA under standard contractual clauses and cookie retention rules. " * 20
    pages = [(k, f"https://h{k % 3}/p{k}", f"h{k % 3}", text + f"number {k}") for k in range(9)]
    source = lambda: spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in (pages[:4], pages[4:6], pages[6:]):  # the stream ends after each file, and begins again from its checkpoint
        _add(spark, tmp_path / "in", part, PAGES)
        _run(streams.stream_clean_chunk_tag(source()), tmp_path)
    _run(streams.stream_clean_chunk_tag(source()), tmp_path)  # nothing new: nothing written twice
    got = spark.read.parquet(f"{tmp_path}/out")
    want = streams.stream_clean_chunk_tag(spark.createDataFrame(pages, PAGES))
    assert got.count() > 9 and sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_alerts_of_nested_hosts_are_those_of_the_batch(spark, tmp_path):
    now = datetime.now()
    schema = "id long, url string, created_at timestamp"
    urls = ["https://a.Example.com/1", "https://b.a.example.com/1", "https://example.com/2", "https://xexample.com/3", "https://other.org/1", "https://c.b.a.example.com/9"]
    rows = [(k, u, now - timedelta(hours=1 if k != 2 else 50)) for k, u in enumerate(urls)]
    watched = spark.createDataFrame([("example.com",), ("A.example.com",), ("b.a.example.com ",), ("example.com",)], "host string")
    tagged = spark.createDataFrame([(u, t) for u in urls for t in ("x", "y")], "url string, tag string")
    _add(spark, tmp_path / "in", rows, schema)
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    _run(streams.stream_alerts(source(), watched, tagged, ["x", "y"]), tmp_path / "all")
    got = sorted((r.id, r.root) for r in spark.read.parquet(f"{tmp_path}/all/out").collect())
    assert got == [(0, "a.example.com"), (1, "b.a.example.com"), (2, "example.com"), (5, "b.a.example.com")]
    _run(streams.stream_alerts(source(), watched, tagged, ["x"], hours=24), tmp_path / "recent")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/recent/out").collect()) == [0, 1, 5]
    low = watched.select(F.lower(F.trim("host")).alias("host"))
    changed = spark.createDataFrame([(i, u.lower(), c) for i, u, c in rows], schema)
    batch = changes.alert_changes(changed, low, tagged.select(F.lower("url").alias("url"), "tag"), ["x", "y"], str(now), 24 * 365)
    assert sorted((r.id, r.root) for r in batch.collect()) == got
