"""Databases, snapshots, JSON files, whole policy records and merged sketches."""

from pyspark.sql import functions as F

from lexmill.operators import chunking, joins, quality
from lexmill.sources import io


def test_a_database_is_read_in_parts_with_pushed_filters(spark):
    url, driver = "jdbc:derby:memory:pages;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1000).select(F.col("id").alias("PAGE_ID"), F.concat(F.lit("https://a.com/"), "id").alias("URL"), (F.col("id") % 10).alias("KIND"))
    rows.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "PAGES").mode("overwrite").save()
    for bounds in (None, (100, 200)):
        table = io.load_table(spark, url, "PAGES", "PAGE_ID", bounds, parts=4, driver=driver)
        assert table.rdd.getNumPartitions() == 4 and table.count() == 1000
        some = table.where("KIND = 3").select("URL")
        plan = some._jdf.queryExecution().toString()
        assert "EqualTo(KIND,3)" in plan and some.count() == 100
    assert io.load_table(spark, url, "PAGES", driver=driver).rdd.getNumPartitions() == 1


def test_a_hot_domain_fills_several_files_and_others_stay(spark, tmp_path):
    path = tmp_path / "snapshots"
    rows = [(k, "hot.com" if k % 10 else f"d{k % 30}.com", f"s{k}", "{}", "<p>", "t") for k in range(3000)]
    snapshots = spark.createDataFrame(rows, "id long, domain string, slug string, meta string, html string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_snapshots(snapshots, str(path), 500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = lambda d: len(list((path / f"domain={d}").glob("*.parquet")))
    assert files("hot.com") >= 6 and files("d0.com") == files("d10.com") == 1
    assert all(spark.read.parquet(str(f)).count() <= 500 for f in (path / "domain=hot.com").glob("*.parquet"))
    assert sorted(r.id for r in spark.read.parquet(str(path)).select("id").collect()) == list(range(3000))
    io.write_snapshots(snapshots.where("domain = 'd0.com'").limit(1), str(path), 500)  # one domain again, the others as they were
    counts = {r.domain: r["count"] for r in spark.read.parquet(str(path)).groupBy("domain").count().collect()}
    assert counts["d0.com"] == 1 and counts["hot.com"] == 2700 and counts["d10.com"] == 100


def test_json_is_written_again_as_it_was(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\n", ["a", "b"]), (2, None, [])], "id long, t string, tags array<string>")
    io.write_json(df, str(tmp_path / "j"))
    io.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "j")).collect())) == sorted(map(tuple, df.collect()))


def test_whole_policy_records(spark, tmp_path):
    (tmp_path / "a.yml").write_text(
        "host: a.com\naliases: [www.a.com]\nhydration: {render_on_status: [404, 410], render_if: {thin_html_min_text_chars: 3000, script_ratio_over: 0.5}, timeout_s: 9, headers: {Accept: text/html, X-N: 1}}\n"
        "cleaning: {remove_selectors: ['.ad']}\nchunking: {size: 200, overlap: 20}\ntagging: {add: [x], team: [t]}\nbackoff: {jitter_seconds: 1}\ndiscovery: {static_max: 5}\n"
    )
    (tmp_path / "b.yml").write_text("host: b.com\nchunking: {overlap: 0}\n")
    policies = io.load_policies(spark, str(tmp_path))
    urls = spark.createDataFrame([(k, u, 404, "x" * 2500, u) for k, u in enumerate(["https://www.a.com/1", "https://b.com/2", "https://c.com/3"])], "doc_id long, url string, status_code int, body string, host string")
    got = {r.doc_id: r.policy for r in joins.with_policy(urls, policies).collect()}
    assert got[0].hydration.headers == {"Accept": "text/html", "X-N": "1"} and got[0].hydration.timeout_s == 9 and got[0].cleaning.remove_selectors == [".ad"]
    assert got[0].discovery.static_max == 5 and got[0].backoff.jitter_seconds == 1.0 and got[0].backoff.base_seconds == 0.3 and got[0].tagging == {"add": ["x"], "team": ["t"]}
    assert got[1].host == "b.com" and got[1].hydration.render_on_status == [] and got[2].host == "default" and got[2].chunking.size is None
    render = {r.doc_id: r.needs_render for r in joins.render_by_policy(urls, policies).collect()}
    assert render == {0: True, 1: False, 2: False}
    thin = {r.doc_id: r.needs_render for r in joins.render_by_policy(urls.withColumn("status_code", F.lit(None).cast("int")), policies).collect()}
    assert thin == {0: True, 1: False, 2: False}
    scripts = joins.render_by_policy(urls.withColumns({"status_code": F.lit(200), "body": F.lit("<script></script>" * 400)}), policies)
    assert {r.doc_id: r.needs_render for r in scripts.collect()} == {0: False, 1: False, 2: False}  # a share of a half is not over it
    texts = urls.select("doc_id", "url", "host", F.lit("abcdefghij" * 100).alias("text"))
    sizes = {k: [r.char_len for r in chunking.chunk_by_policy(texts, policies, least=1).orderBy("chunk_index").collect() if r.doc_id == k] for k in range(3)}
    assert sizes == {0: [200, 200, 200, 200, 200, 100], 1: [800, 200], 2: [800, 320]}
    none = chunking.chunk_sliding(texts.limit(0))
    assert chunking.chunk_corpus(texts, none, policies=policies).count() == 5 + 2 + 2  # a last piece under 120 characters goes
    again = chunking.chunk_corpus(texts, chunking.chunk_sliding(texts), rechunk=True, policies=policies)
    assert again.where("doc_id = 0").count() == 5


def test_merged_sketches_are_near_the_exact_counts(spark):
    chunks = spark.range(60_000).select((F.col("id") % 20_000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("host"), (F.col("id") % 5).alias("day"))
    sketches = quality.chunk_sketches(chunks, "day")
    got = {r.host: r for r in quality.merged_chunk_stats(sketches).collect()}
    exact = {r.host: r for r in chunks.groupBy("host").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("chunks")).collect()}
    for h, r in exact.items():
        assert abs(got[h].docs_chunked - r.docs) < 4 * 0.013 * r.docs and got[h].chunks == r.chunks


def test_merged_counts_are_exact(spark):
    """Also where documents lie in several days and parts, and keys are null."""
    chunks = spark.range(60_000).select(F.when(F.col("id") % 20_000 != 7, F.col("id") % 20_000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("host"), (F.col("id") % 5).alias("day"))
    counts = quality.chunk_counts(chunks, "day")
    again = counts.where("day < 2").unionByName(counts.where("day >= 2"))
    exact = sorted(tuple(r) for r in chunks.groupBy("host").agg(F.countDistinct("doc_id"), F.count("*")).collect())
    assert sorted(tuple(r) for r in quality.merged_chunk_counts(again).collect()) == exact
