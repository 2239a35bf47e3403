"""Hand-made cases of rules and helpers."""

import hashlib
import json
import re
from html import unescape

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill import catalog
from lexmill.functions import helpers as H
from lexmill.functions import markup
from lexmill.functions import texts as T
from lexmill.functions import urls as U
from lexmill.functions.dialect import column
from lexmill.operators import changes, chunking, html, joins, merge, quality, search, similarity
from lexmill.sources import io


def one(spark, rule, value, **options):
    return spark.createDataFrame([(value,)], "x string").select(column(rule, "x", **options)).first()[0]


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTP://WWW.Example.com:80/a/?utm_source=x&b=1#f", "http://example.com/a?b=1"),
        ("https://example.com:8443", "https://example.com:8443/"),
        ("https://example.com/?GCLID=1", "https://example.com/"),
        ("not a url", "not a url"),
    ],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, U.normalize_url, url) == expected


def test_normalize_is_idempotent(spark):
    first = one(spark, U.normalize_url, "https://www.a.com/x//?fbclid=2&c=3#z")
    assert one(spark, U.normalize_url, first) == first


def test_policy_dates(spark):
    dates = lambda text: one(spark, T.policy_dates, text)
    assert dates("x Effective: March 5, 2024 y") == ["effective:2024-03-05"]
    assert dates("Last updated 2 Jan 2024") == ["updated:2024-01-02"]
    assert dates("Effective: March 5, 2024. Updated: 2024-06-01.") == ["effective:2024-03-05", "updated:2024-06-01"]
    for none in ("no date", "Updated: Marketing 5, 2024", "Updated: February 31, 2024", "effective 2024-13-01", None):
        assert dates(none) == []


def test_parse_ts(spark):
    for raw, seconds in {"2024-01-02T03:04:05+00:00": 1704164645, "2024-01-02T05:04:05+02:00": 1704164645, "2024-01-02T03:04:05Z": 1704164645, "2024-01-02T03:04:05": 1704164645, "1704164645": 1704164645, "2024-01-02": 1704153600, "2024-02-30T00:00:00": 0, "never": 0, None: 0}.items():
        assert one(spark, T.parse_ts, raw) == seconds, raw


def test_boilerplate_keeps_every_document(spark):
    note = "All rights are reserved by the owner of this site. "
    df = spark.createDataFrame([("h", k, note + f"Paragraph number {k} of the document is here. Menu") for k in range(3)] + [("h", 3, note), ("h", 4, None), ("g", 5, note)], "host string, doc_id long, text string")
    got = {r.doc_id: r.text for r in similarity.suppress_boilerplate(df, similarity.host_boilerplate(df)).collect()}
    assert got == {**{k: f"Paragraph number {k} of the document is here. Menu" for k in range(3)}, 3: "", 4: "", 5: note.strip()}


def test_near_duplicates_at_distance_seven_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    codes = [rng.getrandbits(128) for _ in range(40)]
    for k in range(160):
        code = codes[k % 40]
        for _ in range(rng.randrange(1, 10)):
            code ^= 1 << rng.randrange(128)
        codes.append(code)
    codes = list(dict.fromkeys(codes))
    df = spark.createDataFrame([(k, f"{c:032x}") for k, c in enumerate(codes)], "doc_id long, simhash string")
    for far in (3, 7):
        want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if 0 < (codes[a] ^ codes[b]).bit_count() <= far}
        got = {(r.a, r.b) for r in similarity.near_duplicates(df, far).collect()}
        assert want and got == want


def test_plans_have_no_task_for_all_rows(spark):
    tags = spark.range(100).selectExpr("id AS doc_id", "concat('t', id % 7) AS tag")
    ids, links = merge.build_tag_dictionary(tags)
    assert [(r.tag_id, r.tag) for r in ids.orderBy("tag_id").collect()] == [(k + 1, f"t{k}") for k in range(7)] and links.count() == 100
    for df in (links, merge.top_per(tags, "tag", 3, None, "doc_id"), joins.match_root(spark.createDataFrame([("https://a.b.c/x",)], "url string"), spark.createDataFrame([("b.c",)], "root string"))):
        plan = df._jdf.queryExecution().toString()
        assert "TakeOrdered" not in plan and "monotonically_increasing_id" not in plan and "SinglePartition" not in plan


def test_token_estimate_rounds_half_to_even(spark):
    assert [one(spark, T.token_estimate, "x" * n, how="round") for n in (1, 6, 10, 14)] == [1, 2, 2, 4]


def test_long_script_block(spark):
    page = "<p>kept</p><script>" + "x</p> \n" * 60_000 + "</script>"
    assert one(spark, T.quick_text, one(spark, T.clean_common, page)) == "kept"


def test_sections():
    page = "<h2 id='a'>Terms</h2><p>One</p><li>Two</li><h3></h3><p>Three</p><script>no</script>"
    assert markup.sections_of(page) == [{"title": "Terms", "text": "One\nTwo", "anchors": ["a"]}, {"title": "(untitled)", "text": "Three", "anchors": []}]
    assert markup.sections_of("<div>only</div>")[0]["title"] == "(document)"
    assert markup.sections_of("") == []


def test_greedy_chunks_progress():
    text = "Sentence one. " * 50
    pieces = chunking.greedy(text, 100, 30, 250)
    assert pieces and all(p in text for p in pieces[:-1])


def test_structured_chunks_end():
    pieces = chunking.structured("x" * 1000 + ". Next one here.", 200, 1, 50)
    assert pieces[0] == "x" * 200 and len(pieces) < 20


def test_sliding_chunks(spark):
    df = spark.createDataFrame([(1, "u", "h", "a" * 1000), (2, "u", "h", ""), (3, "u", "h", None)], "doc_id long, url string, host string, text string")
    got = chunking.chunk_sliding(df).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.char_len) for r in got] == [(0, 800), (1, 320)]


def test_simhash():
    assert H.simhash_of("") == "0" * 32
    assert H.simhash_of("one two three four") == H.simhash_of("One  two three FOUR")
    assert len(H.simhash_of("word")) == 32


@pytest.mark.parametrize("text", ["word", "one two three four", "a b c a b c a b c", "The terms, as of 2024: privacy_policy and more. " * 7, "é", "!!"])
def test_simhash_is_the_vote_of_its_grams(text):
    """N1 bit by bit, with whole numbers: a bit is set if at least as many grams (with repeats) have it as have not."""
    words = re.findall(r"[A-Za-z0-9_]+", text.lower())
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=16).digest(), "big") for g in grams]
    want = sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))
    assert H.simhash_of(text) == f"{want:032x}"


def test_line_diffs(spark):
    """Diffs written out by hand; a removed list item or rule of dashes is a change too."""
    cases = [("a\nb\nc", "a\nx\nc", "--- old\n+++ new\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c"), ("same\n", "same\n", ""), ("- item\nend", "end", "--- old\n+++ new\n@@ -1,2 +1 @@\n-- item\n end"), ("end", "end\n+ more", "--- old\n+++ new\n@@ -1 +1,2 @@\n end\n++ more"), (None, "new", "--- old\n+++ new\n@@ -0,0 +1 @@\n+new"), (None, "", ""), ("a\n\nb", "a\nb", "--- old\n+++ new\n@@ -1,3 +1,2 @@\n a\n-\n b")]
    df = spark.createDataFrame([(str(k), a, b) for k, (a, b, _) in enumerate(cases)], "url string, prev_text string, new_text string")
    got = {int(r.url): (r.diff, r.material_changes) for r in changes.change_records(df).collect()}
    assert got == {k: (d, d != "") for k, (_, _, d) in enumerate(cases)}


def test_near_duplicates(spark):
    words = [f"w{k}" for k in range(400)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:-1], "other"])), (4, ""), (5, "")], "doc_id long, text string")
    got = similarity.near_duplicates(similarity.with_simhash(df), 20).collect()
    assert [(r.a, r.b) for r in got] == [(1, 3)]


def test_simhash_classes_hold_every_row(spark):
    words = [f"w{k}" for k in range(400)]
    near = " ".join([*words[:-1], "other"])
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words).upper()), (3, near), (4, ""), (5, None), (6, near + "!"), (7, "alone here"), (8, "Alone, here"), (9, "no copy")], "doc_id long, text string")
    hashed = similarity.with_simhash(df)
    of = {r.doc_id: r.representative for r in similarity.simhash_classes(hashed).collect()}
    assert of == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 3, 7: 7, 8: 7, 9: 9}
    assert {x for r in similarity.near_duplicates(hashed, 20).collect() for x in (r.a, r.b)} <= set(of.values())
    assert similarity.simhash_classes(hashed.limit(0)).count() == 0


def test_tiny_diff(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("a", "a"), (None, "b")], "p string, q string")
    assert [r[0] for r in df.select(H.tiny_diff("p", "q")).collect()] == ["- b + x", "", ""]


def test_resolve_columns(spark):
    df = spark.createDataFrame([("u", "1", "2")], "link string, hash_a string, hash_b string")
    assert changes.resolve_columns(df).first().asDict() == {"url": "u", "prev_hash": "1", "new_hash": "2"}
    with pytest.raises(ValueError):
        changes.resolve_columns(df.drop("link"))


def test_upsert_is_idempotent(spark):
    t = spark.createDataFrame([("a", "t", "b", "h", 0)], "url string, title string, body string, content_hash string, revisions long")
    n = spark.createDataFrame([("a", None, "c", "k"), ("z", None, "d", None)], "url string, title string, body string, content_hash string")
    once = merge.upsert_with_revision(t, n)
    twice = merge.upsert_with_revision(once, n)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", "t", "c", "k", 1), ("z", "", "d", None, 0)]


def test_hits_by_host_counts_all_hits(spark):
    chunks = spark.range(50_200).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.when(F.col("id") < 50_100, "a").otherwise("b").alias("host"), F.when(F.col("id") < 50_150, "the License, the cookie").otherwise("no licenses").alias("text"))
    got = {r.host: r.hits for r in search.hits_by_host(chunks, ["license", "cookie"]).collect()}
    assert got == {"a": 50_100, "b": 50}
    assert sum(r.hits for r in search.hits_by_host(chunks, ["license", "cookie"], cap=30).collect()) == 30


def test_snippet(spark):
    df = spark.createDataFrame([("one two three Cookie, rules five six",), ("none here",)], "text string")
    got = [r[0] for r in df.select(search.snippet("text", ["cookie", "rules"], 3)).collect()]
    assert got == [" … three [Cookie,] [rules] … ".replace("three", "three"), "none here"]


def test_seeds_and_labels(spark, tmp_path):
    (tmp_path / "seeds.json").write_text(json.dumps({"a": ["x.com/", "https://y.com"], "b": ["https://x.com", ""]}))
    got = io.load_seeds(spark, str(tmp_path / "seeds.json")).orderBy("url").collect()
    assert [tuple(r) for r in got] == [("a", "https://x.com"), ("a", "https://y.com")]
    io.write_csv_report(spark.createDataFrame([("l", "d.com")], "label string, domain string"), str(tmp_path / "csv"))
    assert io.load_labels(spark, str(tmp_path / "csv")).collect()[0].domain == "d.com"


def test_catalog_and_policies(spark, tmp_path):
    (tmp_path / "sources.yaml").write_text("- {name: A, home: a.com}\n- {name: B}\n")
    assert io.load_catalog(spark, str(tmp_path / "sources.yaml")).first().priority == 5
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.yml").write_text("host: a.com\naliases: [www.a.com]\nnormalization: {query_param_drops: [ref]}\n")
    table = io.load_policies(spark, str(tmp_path / "p"))
    urls = spark.createDataFrame([("https://www.a.com/x?ref=1&b=2",), ("https://b.com/",)], "url string")
    got = joins.normalized_by_policy(urls, table).orderBy("url").collect()
    assert [r.canonical_url for r in got] == ["https://b.com/", "https://a.com/x?b=2"]


def test_sitemaps(spark):
    df = spark.createDataFrame([("<urlset><url><loc> https://a/1 </loc></url><url><loc>x",), ("<",)], "xml string")
    assert [(r.kind, r.loc) for r in io.parse_sitemaps(df).collect()] == [("page", "https://a/1")]


def test_salvage_cleans_only_empty(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "kept"), (2, "<p>b</p>", "")], "id long, body string, clean_text string")
    assert [r.id for r in html.smart_clean(df, mode="salvage").collect()] == [2]


def test_report_text(spark):
    df = spark.createDataFrame([('line one ]]\nline one\n[^1]: source ]\n{"className": "x"}\nâ€œq',)], "text string")
    got = df.select(html.sanitize_report_text("text")).first()[0]
    assert got.split("\n")[:2] == ["line one", "[^1]: source ]"] and "className" not in got


def test_unescape_and_urls(spark):
    df = spark.createDataFrame([("&eacute;&amp;", "https://a.com/x/y", "../z#t")], "s string, b string, h string")
    assert tuple(df.select(H.unescaped("s"), H.joined_url("b", "h"), F.length(H.blake2b160("s"))).first()) == ("é&", "https://a.com/z", 40)


def test_like_lists_ignore_case(spark):
    assert one(spark, U.is_bad_url, "https://a.com/Static/x") and one(spark, U.is_bad_url, "https://a.com/LOGO.PNG") and not one(spark, U.is_bad_url, "https://a.com/privacy")


def test_cleaners_resolve_every_entity(spark):
    page = "<p>caf&eacute; &#8217;x&#x27;&nbsp;</p><p>a  &amp;lt; b</p>"
    df = spark.createDataFrame([(1, page, ""), (2, None, None), (3, "<p>plain</p>", "")], "id long, body string, clean_text string")
    assert [r.clean_text for r in html.smart_clean(df).orderBy("id").collect()] == ["café ’x'\n\na &lt; b", "", "plain"]
    assert [r.text for r in html.strip_html_keep_text(df).orderBy("id").collect()] == ["café ’x' a &lt; b", "", "plain"]
    assert [r.text for r in html.pick_text(df).orderBy("id").collect()] == ["café ’x'\n\na &lt; b", "", "plain"]


def test_cleaning_queries_resolve_what_their_sql_does(spark, tmp_path):
    """Entities that are cut off or rare stay in the queries with SQL; the jobs, and the queries over them, resolve them."""
    page = "<p>fish &amp</p><p>caf&eacute &amp; &lt;b&gt; &#65; x</p>"
    spark.createDataFrame([(1, "http://a.com/x", page), (3, "http://a.com/x", page + "<i></i>" * 900)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_to_text", "pick_text", "smart_clean", "strip_html_keep_text"):
        got = catalog.queries()[name](spark, str(tmp_path))
        found = con.execute(catalog.oracle_sql()[name])
        order = [x[0] for x in found.description]
        assert sorted(tuple(r) for r in got.select(*order).collect()) == sorted(found.fetchall())
        text = "clean_text" if name == "smart_clean" else "text"
        whole = {r.id: r[text] for r in catalog.queries()[name + "_entities"](spark, str(tmp_path)).collect()}
        assert "&amp" in got.where("id = 3").first()[text] and "fish &" in whole[3] and "café &" in whole[3] and "&amp" not in whole[3]


def test_references_are_resolved_as_in_whole_texts(spark):
    texts = ["", "&", "&&", "a&amp;lt;b", "&ampx &notit; &#x;&#x41&#65b &#0; &#xFFFFFF; &NotEqualTilde;", "&" + "é😀" * 20 + ";", "&amp", "x &;&#; y\n&lt\t&gt", None, "plain", "&nbsp;" * 50 + "end", "&CounterClockwiseContourIntegral;z"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "id long, x string")
    got = [r.t for r in H.with_unescaped(df, {"t": F.col("x")}).orderBy("id").collect()]
    assert got == [None if x is None else unescape(x) for x in texts]


def test_spaces_left_by_tags_stay(spark):
    df = spark.createDataFrame([(1, "<p>one<b> </b>two \t three</p>", "")], "id long, body string, clean_text string")
    assert html.smart_clean(df).first().clean_text == "one   two three"


def test_fallback_cleaner(spark):
    df = spark.createDataFrame([(1, "<i></i>" * 900 + "&eacute; short", "")], "id long, body string, clean_text string")
    r = html.smart_clean(df).first()
    assert (r.strategy, r.clean_text) == ("fallback", "é short")


def test_sieve_sanitises_first(spark):
    df = spark.createDataFrame([("https://a.com/privacy&quot;)", "a.com"), ("https://a.com/privacy<b>x.png", "a.com"), (" https://a.com/privacy", "a.com"), (None, "a.com"), ("https://b.com/privacy", "a.com")], "url string, root string")
    assert [r.keep for r in joins.keep_urls(df, "url", "root").collect()] == [True, True, False, False, False]
    assert joins.sanitized_urls(df).first().clean == "https://a.com/privacy"


def test_links_with_dots(spark):
    page = "<a href='../privacy'>a</a><a href='./terms#x'>b</a><a href='/policy/../legal'>c</a><a href='tos'>d</a>"
    df = spark.createDataFrame([("https://a.com/x/y/z", page)], "url string, body string")
    assert [r.link for r in html.extract_links(df, synthetic=False).orderBy("position").collect()] == ["https://a.com/x/privacy", "https://a.com/x/y/terms", "https://a.com/legal"]


def test_like_reports_ignore_case(spark):
    df = spark.createDataFrame([("https://a.com/Privacy?UTM_source=1",), ("https://a.com/x?GCLID=2",), ("https://b.com/Policy",)], "url string")
    assert {r.host: r.trackers for r in quality.url_param_stats(df).collect()} == {"a.com": 2, "b.com": 0}
    have = {(r.host, r.surface): r.have for r in quality.coverage_check(df).collect()}
    assert have["a.com", "privacy"] == 1 and have["a.com", "terms"] == 0 and have["b.com", "terms"] == 1


def test_fetches_without_body_stay_queued(spark):
    docs = spark.createDataFrame([(k, f"u{k}", 0, "old", "", "h", 0, "e") for k in range(4)], "id long, url string, status_code int, body string, clean_text string, content_hash string, retry_count long, last_error string")
    fetches = spark.createDataFrame([("u0", 200, "", False, False), ("u1", 429, "page", True, False), ("u2", 200, "page", False, False)], "url string, code int, new_body string, rendered boolean, asset boolean")
    got = {r.url: (r.outcome, r.status_code, r.last_error, r.queue_status) for r in merge.apply_fetch_results(docs, fetches).collect()}
    assert got == {"u0": ("fetched", 200, None, None), "u1": ("fetched", 200, "http-429", "hydrated"), "u2": ("fetched", 200, None, "hydrated"), "u3": ("none", 0, "e", None)}


def test_overlaps_of_structured_chunks_chain():
    text = "Aaaa bbbb. Cccc. Dddd eeee ffff."
    assert chunking.structured(text, 18, 1, 8) == ["Aaaa bbbb. Cccc.", "Dddd eeee ffff."]
    assert chunking.structured("One. Two. Six.", 6, 1, 2) == ["One.", "Two.", "Six."]
    assert chunking.structured("Ab. Cd. Ef.", 7, 1, 4) == ["Ab. Cd.", "Cd. Ef."]
    assert chunking.structured("Abcdefghijklmnop. Xy. Bcdefghijklmnopq.", 20, 1, 5) == ["Abcdefghijklmnop.", "mnop. Xy.", ". Xy. Bcdefghijklmnopq."]


def test_chunk_sizes_by_host(spark):
    df = spark.createDataFrame([(1, "u", "a.com", "x" * 1000), (2, "u", "B.com", "x" * 1000)], "doc_id long, url string, host string, text string")
    got = sorted((r.doc_id, r.chunk_index, r.char_len) for r in chunking.chunk_sliding(df, sizes={"b.com": (500, None), "c.com": (None, 9)}).collect())
    assert got == [(1, 0, 800), (1, 1, 320), (2, 0, 500), (2, 1, 500), (2, 2, 240)]


def test_ranks_are_of_the_whole_index(spark):
    rows = [(k, f"https://h/{k}", "t", "privacy", "EU" if k < 2 else "us", "the privacy rules " + "word " * k) for k in range(6)] + [(9, "https://h/9", "t", "x", "us", "other text")]
    docs = spark.createDataFrame(rows, "id long, url string, title string, doc_type string, jurisdiction string, clean_text string")
    ranks = lambda **o: {r.id: r["rank"] for r in search.search_documents(docs, ["privacy"], **o).collect()}
    assert ranks(jurisdiction="eu") == {k: v for k, v in ranks().items() if k < 2}


def test_index_has_no_shuffle(spark):
    df = spark.createDataFrame([(1, "The cat, the dog"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    got = search.build_index(df, "doc_id")
    assert sorted(map(tuple, got.collect())) == [(1, "cat", 1, [1], 4), (1, "dog", 1, [3], 4), (1, "the", 2, [0, 2], 4), (4, "x", 1, [0], 1)]
    assert "Exchange" not in got._jdf.queryExecution().toString()


def test_plain_words_and_sizes(spark):
    df = spark.createDataFrame([(1, "Don't stop_now or stop"), (2, "don stop")], "id long, text string")
    assert [r.id for r in search.near(df, "don't:now:2", plain=True).collect()] == [1]
    assert [r.id for r in search.near(df, "stop:now:1", plain=True).collect()] == [1] and not search.near(df, "stop:now:1").collect()
    sizes = spark.createDataFrame([(n,) for n in (None, 0, 512, 1536, 2048, 1 << 20, 1234567890)], "n long")
    assert [r[0] for r in sizes.select(column(T.human_size, "n")).collect()] == ["0 KB", "0 KB", "0 KB", "2 KB", "2 KB", "1.0 MB", "1,177.4 MB"]


def test_raw_links_of_a_page(spark):
    page = 'see https://a.com/privacy-policy), "http://a.com/terms?x=1" <a href=https://a.com/privacy-policy>x</a> https://b.com/privacy ftp://a.com/legal https://a.com/logo.png'
    df = spark.createDataFrame([("https://a.com/x", page), ("https://c.com", None)], "url string, body string")
    assert [r.link for r in html.extract_raw_links(df).orderBy("position").collect()] == ["https://a.com/privacy-policy", "http://a.com/terms?x=1"]
    assert [r.position for r in html.extract_raw_links(df, 1).collect()] == [1]


def test_row_wise_ranks_equal_those_of_postings(spark):
    rows = [(k, " ".join(["the"] * (k % 4) + ["cookie"] * (k % 3) + ["x"] * (k % 5))) for k in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    direct = search.bm25(search.postings_of(df, "id", ["the", "cookie"]), search.corpus_size(df), "id", ["the", "cookie"])
    got = {r.id: r.rank for r in search.ranked(df, ["the", "cookie", "the"]).collect()}
    assert got == pytest.approx({r.id: r["rank"] for r in direct.collect()})
    both = {r.id for r in search.ranked(df, ["the", "cookie"], all_=True).collect()}
    assert both == {r.id for r in search.match(search.build_index(df, "id"), "id", all_=["the", "cookie"]).collect()}


def test_simhash_of_a_fixed_text():
    import hashlib

    text = "The quick brown fox jumps"
    votes = [0] * 128
    for gram in ("the quick brown", "quick brown fox", "brown fox jumps"):
        bits = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=16).digest(), "big")
        votes = [v + (1 if bits >> (127 - k) & 1 else -1) for k, v in enumerate(votes)]
    assert H.simhash_of(text) == f"{sum(1 << (127 - k) for k, v in enumerate(votes) if v >= 0):032x}"
