"""The stored index: rows of the direct search, pruned buckets, spread hot terms, rebuilds."""

from pathlib import Path

from pyspark.sql import functions as F

from lexmill.operators import search, stored


def _texts(spark, n=60):
    rows = [(k, f"the word{k % 7} of " + ("cookie policy " if k % 5 == 0 else "") + "the end" * (k % 2)) for k in range(n)]
    return spark.createDataFrame([*rows, (n, ""), (n + 1, None)], "doc_id long, text string")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_searches_equal_the_direct_ones(spark, tmp_path):
    texts, path = _texts(spark), str(tmp_path / "index")
    stored.write_index(texts, path, "doc_id", buckets=8)
    direct = search.build_index(texts, "doc_id")
    assert _rows(stored.read_postings(spark, path).select(direct.columns)) == _rows(direct)
    for o in ({"all_": ["the", "cookie"]}, {"any_": ["word1", "word2"]}, {"all_": ["the"], "none": ["cookie"]}, {"phrase": ["cookie", "policy"]}, {"prefix": "word"}, {"all_": ["absent"]}):
        assert _rows(stored.stored_match(spark, path, "doc_id", **o)) == _rows(search.match(direct, "doc_id", **o)), o
    ranks = lambda df: _rows(df.select("doc_id", F.round("rank", 9)))
    assert ranks(stored.stored_bm25(spark, path, "doc_id", ["the", "cookie"])) == ranks(search.bm25(direct, search.corpus_size(texts), "doc_id", ["the", "cookie"]))


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    path = str(tmp_path / "index")
    stored.write_index(_texts(spark), path, "doc_id", buckets=8)
    found = stored.read_postings(spark, path, ["cookie"])
    files = {Path(r[0]).parent.name for r in found.select(F.input_file_name()).distinct().collect()}
    assert files == {f"bucket={stored.bucket_of('cookie', 8)}"}
    plan = _plan(found)
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,cookie)" in plan


def test_a_hot_term_is_spread_and_rebuilds_replace(spark, tmp_path):
    path = tmp_path / "index"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored.write_index(_texts(spark, 400), str(path), "doc_id", buckets=4, files=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = stored.bucket_of("the", 4)
    assert len(list((path / "postings" / f"bucket={hot}").glob("*.parquet"))) > 1
    fewer = _texts(spark, 10)
    stored.write_index(fewer, str(path), "doc_id", buckets=4, only=[hot])
    now = {r.bucket: r.n for r in spark.read.parquet(str(path / "postings")).groupBy("bucket").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert now[hot] == 10 and max(now.values()) > 10
    stored.write_index(fewer, str(path), "doc_id", buckets=4)
    assert _rows(stored.read_postings(spark, str(path)).select("doc_id", "term")) == _rows(search.build_index(fewer, "doc_id").select("doc_id", "term"))
    assert stored.read_size(spark, str(path)).first().docs == 12


def test_stems_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(1, "conditional policies"), (2, "a condition of the policy")], "doc_id long, text string")
    stored.write_index(df, str(tmp_path / "i"), "doc_id", stem=True, buckets=2)
    assert _rows(stored.stored_match(spark, str(tmp_path / "i"), "doc_id", all_=["condit", "polici"])) == [(1,), (2,)]
