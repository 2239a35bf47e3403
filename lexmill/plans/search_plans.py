"""Queries of search, ranking and answers, and of the streaming forms, with their SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions import urls as U
from ..functions.dialect import DUCK, column
from ..llm.shared import written
from ..operators import changes as D
from ..operators import search as Q
from ..operators import stored as I
from ..operators.merge import first_per
from ..streaming import streams as ST
from . import fixtures as X
from .table_plans import TC, W, chunks_of

TERMS = ["the", "license", "cookie"]
BOTH = ["the", "of"]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.policy_texts(spark, sf_dir)


_TOKENS = f"tokens AS (SELECT doc_id, host, url, text, {T.words_of(DUCK, 'text')} AS w FROM texts)"
_POSTINGS = "postings AS (SELECT doc_id, term, count(*) AS tf, list(i ORDER BY i) AS positions, any_value(n) AS doc_len FROM (SELECT doc_id, w[i] AS term, i - 1 AS i, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tokens)) GROUP BY doc_id, term)"


def _bm25_sql(key: str, table: str, text: str, terms: list[str], size_table: str | None = None) -> str:
    """CTEs w (words), p (postings of the terms) and ranks."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""w AS (SELECT {key}, {T.words_of(DUCK, text)} AS w FROM {table}), p AS (SELECT {key}, t AS term, len(list_filter(w, lambda x: x = t)) AS tf, len(w) AS doc_len FROM w, (SELECT unnest([{listed}]) AS t)),
df AS (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY 1), size AS (SELECT count(*) AS docs, avg(len({T.words_of(DUCK, text)})) AS avg_len FROM {size_table or table}),
ranks AS (SELECT {key}, -sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / avg_len))) AS rank FROM p JOIN df USING (term), size WHERE tf > 0 GROUP BY {key})"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    return Q.bm25(Q.postings_of(t, "doc_id", TERMS), Q.corpus_size(t), "doc_id", TERMS).select("doc_id", F.round("rank", 6).alias("rank"))


_MATCHES = {"both": {"all_": BOTH}, "some": {"any_": ["cookie", "license"]}, "without": {"all_": ["the"], "none": ["cookie"]}, "phrase": {"phrase": ["you", "have", "the", "right"]}, "prefix": {"prefix": "cook"}}


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings that the rules ask for are built once, and each rule reads them."""
    terms = sorted({t for o in _MATCHES.values() for k in ("all_", "any_", "none", "phrase") for t in o.get(k, ())})
    prefixes = [o["prefix"] for o in _MATCHES.values() if "prefix" in o]
    wanted = lambda t: reduce(lambda a, p: a | t.startswith(p), prefixes, t.isin(terms))
    p = written(Q.build_index(_texts(spark, sf_dir), "doc_id", only=wanted))
    out = [Q.match(p, "doc_id", **o).select(F.lit(k).alias("rule"), "doc_id") for k, o in _MATCHES.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Writes the index of the texts and gives its folder."""
    from uuid import uuid4

    path = f"{_folder(spark)}/index-{uuid4().hex}"
    I.write_index(_texts(spark, sf_dir), path, "doc_id", buckets=16)
    return path


def _stored_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored(spark, sf_dir)
    out = [I.stored_match(spark, path, "doc_id", **o).select(F.lit(k).alias("rule"), "doc_id") for k, o in _MATCHES.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


_MATCH_SQL = (
    W(X.TEXTS, _TOKENS)
    + """SELECT 'both' AS rule, doc_id FROM tokens WHERE list_contains(w, 'the') AND list_contains(w, 'of') UNION ALL SELECT 'some', doc_id FROM tokens WHERE list_contains(w, 'cookie') OR list_contains(w, 'license')
UNION ALL SELECT 'without', doc_id FROM tokens WHERE list_contains(w, 'the') AND NOT list_contains(w, 'cookie') UNION ALL SELECT 'phrase', doc_id FROM tokens WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' you have the right ')
UNION ALL SELECT 'prefix', doc_id FROM tokens WHERE len(list_filter(w, lambda x: starts_with(x, 'cook'))) > 0"""
)


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first stored vector is the query; there is at most one row to fetch."""
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").select("embedding").first()
    return [float(v) for v in row["embedding"]] if row else [0.0]


_QUERY_VECTOR = "qv AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_COSINE = "list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))))"


def _keyed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).withColumn("vec_key", F.col("doc_id"))


def _hybrid(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return Q.hybrid_rank(_keyed_chunks(spark, sf_dir), TERMS, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), _vector(spark, sf_dir), k=k)


_HYBRID = f"""{W(*TC, _bm25_sql("chunk_id", "chunks", "text", TERMS), _QUERY_VECTOR)}, hits AS (SELECT c.*, rank FROM chunks c JOIN (SELECT * FROM ranks ORDER BY rank, chunk_id LIMIT 100) r USING (chunk_id)),
sims AS (SELECT h.*, coalesce(s.sim, 0.0) AS sim FROM hits h LEFT JOIN (SELECT vec_id, {_COSINE} AS sim FROM embeddings, qv) s ON h.doc_id = s.vec_id),
b AS (SELECT min(rank) AS lo, max(rank) AS hi, min(sim) AS ls, max(sim) AS hs FROM sims),
scored AS (SELECT chunk_id, url, host, text, round(0.55 * CASE WHEN hi > lo THEN (hi - rank) / (hi - lo) ELSE 0 END + 0.45 * CASE WHEN hs > ls THEN (sim - ls) / (hs - ls) ELSE 0 END, 6) AS score FROM sims, b)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.answer_sentences(_hybrid(spark, sf_dir), " ".join(TERMS))


_ASKED = "[" + ", ".join(f"'{t}'" for t in sorted(TERMS)) + "]"
_ANSWER_SQL = f"""{_HYBRID}, top AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 20),
each AS (SELECT chunk_id, host, url, s[k] AS sentence, k - 1 AS k FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM (SELECT *, {T.sentences(DUCK, "text", answers=True)} AS s FROM top))),
tok AS (SELECT *, {T.words_of(DUCK, "sentence")} AS t FROM each),
val AS (SELECT *, round(CASE WHEN len(t) = 0 THEN 0 ELSE (2 * len(list_intersect(t, {_ASKED})) + len(list_filter(t, lambda x: list_contains({_ASKED}, x)))) / log2(10.0 + len(t)) END, 6) AS score FROM tok),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, chunk_id, k) AS r FROM val WHERE score > 0) WHERE r <= 2 ORDER BY score DESC, chunk_id, k LIMIT 6),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id, k) AS place FROM capped), cites AS (SELECT url, row_number() OVER (ORDER BY min(place)) AS cite FROM placed GROUP BY url)"""


def _search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.search_documents(X.docs(spark, sf_dir), BOTH, jurisdiction=" EU").select("id", "doc_type", "url", "title", "jurisdiction", "rank")


_SEARCH_DOCS = f"""{W(X.DOCS)}, {_bm25_sql("id", "docs", "clean_text", BOTH)},
hits AS (SELECT d.*, rank, {U.search_canon(DUCK, "url")} AS canon FROM docs d JOIN ranks USING (id) WHERE trim(lower(coalesce(jurisdiction, ''))) = 'eu' AND id IN (SELECT id FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'of')))
SELECT id, coalesce(doc_type, '') AS doc_type, url, coalesce(nullif(title, ''), url) AS title, coalesce(nullif(trim(jurisdiction), ''), 'global') AS jurisdiction, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY rank, url) AS k FROM hits) WHERE k = 1 ORDER BY rank, url LIMIT 25"""


def _ranked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.docs(spark, sf_dir)
    return Q.dedupe_canonical(d.withColumn("rank", -F.length("body")).select("id", "url", "rank"))


def _minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    return Q.minmax_normalize(e, "value", "share").select("event_id", F.round("share", 6).alias("share"))


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' file as a stream of changes."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(sf_dir if sf_dir.endswith("/") else sf_dir + "/", pathGlobFilter="events.parquet")
    return source.select(F.col("event_id").alias("id"), F.concat(F.lit("https://host"), F.expr("user_id % 23").cast("string"), F.lit(".example.com/u/"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("created_at"), F.md5("event_type").alias("content_hash"), F.col("event_type").alias("kind"), F.concat(F.lit("host"), F.expr("user_id % 23").cast("string"), F.lit(".example.com")).alias("host"))


def _streamed(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Runs a stream over the events' file to its end and returns what it wrote."""
    from uuid import uuid4

    folder = f"{_folder(spark)}/stream-{uuid4().hex}"
    query = build(_shaped(spark, sf_dir)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _streamed_counts(spark: SparkSession, sf_dir: str, build, *keys: str) -> DataFrame:
    """Runs a windowed count to its end in update mode, where the last windows need no later event to close, and returns the last state of each."""
    from uuid import uuid4

    folder = f"{_folder(spark)}/stream-{uuid4().hex}"
    query = build(_shaped(spark, sf_dir)).writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return first_per(spark.read.parquet(f"{folder}/out").drop("batch"), list(keys), F.desc("_batch")).drop("_batch")


def _folder(spark: SparkSession) -> str:
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or tempfile.gettempdir()).rstrip("/")


_PAIRS = "pairs AS (SELECT * FROM (SELECT id, url, created_at, content_hash AS new_hash, lag(content_hash) OVER w AS prev_hash FROM revisions WINDOW w AS (PARTITION BY url ORDER BY created_at, id)) WHERE prev_hash IS NOT NULL AND prev_hash <> new_hash)"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    revs = X.revisions(spark, sf_dir)
    tagged = revs.select("url", F.col("kind").alias("tag")).distinct()
    watched = spark.createDataFrame([("host3.example.com",), ("host7.example.com",)], "host string")
    return _streamed(spark, sf_dir, lambda s: ST.stream_alerts(s.select("id", "url", "created_at"), watched, tagged, ["error"]))


def _value_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = {k: spark.conf.get(k, None) for k in ST.ROCKSDB}
    for k, v in ST.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        return _streamed(spark, sf_dir, ST.stream_changes)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


PLANS = {
    "build_index": (lambda s, d: Q.build_index(_texts(s, d), "doc_id").select("doc_id", "term", "tf", "doc_len", F.array_join(F.slice("positions", 1, 5), ",").alias("first_positions")), W(X.TEXTS, _TOKENS, _POSTINGS) + "SELECT doc_id, term, tf, doc_len, array_to_string(positions[1:5], ',') AS first_positions FROM postings"),
    "build_index_stemmed": (lambda s, d: Q.build_index(_texts(s, d), "doc_id", stem=True).groupBy("term").agg(F.sum("tf").alias("tf")), None),
    "match": (_match, _MATCH_SQL),
    "bm25": (_bm25, W(X.TEXTS, _bm25_sql("doc_id", "texts", "text", TERMS)) + "SELECT doc_id, round(rank, 6) AS rank FROM ranks"),
    "stored_match": (_stored_match, _MATCH_SQL),
    "stored_bm25": (lambda s, d: I.stored_bm25(s, _stored(s, d), "doc_id", TERMS).select("doc_id", F.round("rank", 6).alias("rank")), W(X.TEXTS, _bm25_sql("doc_id", "texts", "text", TERMS)) + "SELECT doc_id, round(rank, 6) AS rank FROM ranks"),
    "snippet": (lambda s, d: _texts(s, d).select("doc_id", Q.snippet("text", ["the", "cookie", "account"], 10).alias("snippet")), None),
    "proximity": (lambda s, d: Q.near(chunks_of(s, d), "the:of:2,and:the:4").select("chunk_id"), W(*TC) + f"SELECT chunk_id FROM chunks WHERE {T.within_window(DUCK, T.words_of(DUCK, 'text'), 'the', 'of', 2)} AND {T.within_window(DUCK, T.words_of(DUCK, 'text'), 'and', 'the', 4)}"),
    "proximity_plain": (lambda s, d: Q.near(chunks_of(s, d), "the:of:2,and:the:4", plain=True).select("chunk_id"), W(*TC) + f"SELECT chunk_id FROM chunks WHERE {T.within_window(DUCK, T.plain_words_of(DUCK, 'text'), 'the', 'of', 2)} AND {T.within_window(DUCK, T.plain_words_of(DUCK, 'text'), 'and', 'the', 4)}"),
    "dedupe_canonical": (_ranked_docs, W(X.DOCS) + f"SELECT id, url, rank, canon FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY rank, url) AS k FROM (SELECT id, url, -length(body) AS rank, {U.search_canon(DUCK, 'url')} AS canon FROM docs)) WHERE k = 1"),
    "minmax_normalize": (_minmax, "SELECT event_id, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS share FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)"),
    "search_documents": (_search_documents, _SEARCH_DOCS),
    "search_chunks": (lambda s, d: Q.search_chunks(chunks_of(s, d), BOTH, "the:of:2").select("chunk_id", "host", "url", "text", "rank"), W(*TC) + f", near AS (SELECT * FROM chunks WHERE {T.within_window(DUCK, T.words_of(DUCK, 'text'), 'the', 'of', 2)}), {_bm25_sql('chunk_id', 'chunks', 'text', BOTH)} SELECT chunk_id, host, url, substr(text, 1, 3000) AS text, round(rank, 6) AS rank FROM near JOIN ranks USING (chunk_id) ORDER BY ranks.rank, chunk_id LIMIT 50"),
    "hits_by_host": (lambda s, d: Q.hits_by_host(chunks_of(s, d), ["license", "cookie"]), W(*TC) + f", {_bm25_sql('chunk_id', 'chunks', 'text', ['license', 'cookie'])} SELECT host, count(*) AS hits FROM chunks JOIN ranks USING (chunk_id) GROUP BY host"),
    "hybrid_rank": (lambda s, d: _hybrid(s, d).select("place", "chunk_id", "url", "score"), _HYBRID + " SELECT row_number() OVER (ORDER BY score DESC, chunk_id) AS place, chunk_id, url, score FROM scored ORDER BY score DESC, chunk_id LIMIT 20"),
    "cosine_topk": (lambda s, d: Q.cosine_topk(s.read.parquet(f"{d}/embeddings.parquet"), _vector(s, d), 25).select("vec_id", F.round("score", 6).alias("score")), W(_QUERY_VECTOR) + f"SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings, qv ORDER BY {_COSINE} DESC, vec_id LIMIT 25"),
    "answer_sentences": (_answers, _ANSWER_SQL + " SELECT place, sentence, url, score, cite FROM placed JOIN cites USING (url)"),
    "synthesize_answer": (lambda s, d: Q.synthesize_answer(_hybrid(s, d), " ".join(TERMS)), None),
    "stream_changes": (lambda s, d: _streamed(s, d, ST.stream_changes_grouped).select("id", "url", "prev_hash", "new_hash"), W(X.REVISIONS, _PAIRS) + "SELECT id, url, prev_hash, new_hash FROM pairs"),
    "stream_changes_state": (lambda s, d: _value_state(s, d).select("id", "url", "prev_hash", "new_hash"), W(X.REVISIONS, _PAIRS) + "SELECT id, url, prev_hash, new_hash FROM pairs"),
    "stream_enqueue": (lambda s, d: _streamed(s, d, lambda x: ST.stream_enqueue(x, "40 days").select("url")), W(X.REVISIONS) + "SELECT DISTINCT url FROM revisions"),
    "stream_host_activity": (lambda s, d: _streamed_counts(s, d, lambda x: ST.stream_host_activity(x, "1 day"), "start", "host").select("start", "host", "fetched", "hydrated", "errors"), "SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS start, concat('host', user_id % 23, '.example.com') AS host, count(*) AS fetched, count(*) FILTER (event_type <> 'error') AS hydrated, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2"),
    "stream_alerts": (lambda s, d: _alerts(s, d).select("id", "url", "root"), W(X.REVISIONS) + "SELECT id, url, regexp_extract(url, '://([^/]*)', 1) AS root FROM revisions WHERE regexp_extract(url, '://([^/]*)', 1) IN ('host3.example.com', 'host7.example.com') AND url IN (SELECT url FROM revisions WHERE kind = 'error')"),
    "clean_chunk_tag": (lambda s, d: ST.stream_clean_chunk_tag(X.docs(s, d).withColumn("host", column(U.host_of, "url"))), None),
    "changes_pairs_first": (lambda s, d: D.revision_pairs(X.revisions(s, d)).groupBy("url").agg(F.count("*").alias("changes"), F.min("id").alias("first_id")), W(X.REVISIONS, _PAIRS) + "SELECT url, count(*) AS changes, min(id) AS first_id FROM pairs GROUP BY url"),
}
