"""Policy-shaped inputs derived from the given tables, in Spark and as SQL, so that rules have something to select.

Every row of a given table gives a row here: work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.dialect import DUCK, SPARK, Dialect

PATHS = ("/privacy", "/legal/terms", "/cookies", "/community-guidelines", "/en-gb/safety", "/eu/privacy-policy", "/ads/policy", "/dmca", "/sitemap.xml", "/static/a.png", "/login?next=/x", "/help/policies", "/blog/a/b/c/d/privacy", "/children", "/delete-account", "/random")
SENTENCES = (
    "You have the right to access and rectify your personal data under the GDPR rules today.",
    "Users may delete an account at any time; deletion removes the profile within thirty days.",
    "We use cookies to remember choices, and cookie retention is limited to twelve months.",
    "We transfer data outside the EEA under standard contractual clauses approved by the EU.",
    "Children under thirteen need parental consent before they may open an account with us.",
    "Effective: March 5, 2024 these terms of service replace every earlier version of them.",
    "Last updated: January 2, 2024 and reviewed by the privacy team for accuracy and scope.",
    "Please log in to continue reading the moderation report and your account status page.",
    "Counterfeit or replica goods are prohibited items, and refunds follow our returns code.",
    "Advertising partners may target audiences, but profiling of minors is not permitted here.",
    "The developer API is covered by the platform policy and by section 12 of the agreement.",
    "No medical claims: products that cure a disease or symptom need clinical evidence first.",
)
DOC_TYPES = ("privacy", "terms", "", None, "ads", "policy")


def _case(n: str, values) -> str:
    return f"CASE {n} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else DUCK.text(v)}" for k, v in enumerate(values)) + " END"


def _docs_columns(d: Dialect) -> dict[str, str]:
    path = _case("page_id % 16", PATHS)
    tail = d.extract("url", "[?#].*$")
    return {
        "id": "page_id",
        "url": f"concat({U.scheme(d, 'url')}, '://', CASE WHEN page_id % 5 = 0 THEN 'www.' ELSE '' END, {U.netloc(d, 'url')}, {path}, {tail})",
        "doc_type": _case("page_id % 6", DOC_TYPES),
        "title": d.extract("html", "<title>([^<]*)</title>", 1),
        "body": "CASE WHEN page_id % 11 = 0 THEN '' ELSE html END",
        "clean_text": f"CASE WHEN page_id % 3 = 0 THEN '' ELSE {d.replace_all('html', '<[^>]+>', ' ')} END",
        "status_code": "CASE page_id % 7 WHEN 2 THEN 304 WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN NULL ELSE 200 END",
        "render_mode": "CASE WHEN page_id % 4 = 0 THEN 'render' ELSE 'static' END",
        "last_error": "CASE WHEN page_id % 13 = 0 THEN 'http-429' WHEN page_id % 17 = 0 THEN '' END",
        "retry_count": "page_id % 5",
        "fetched_at": "CASE WHEN page_id % 9 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * page_id END",
        "content_hash": "CASE WHEN page_id % 11 = 0 THEN NULL ELSE md5(html) END",
        "jurisdiction": "CASE page_id % 4 WHEN 0 THEN 'EU ' WHEN 1 THEN '' ELSE 'global' END",
    }


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the shape of documents."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(*[F.expr(x).alias(c) for c, x in _docs_columns(SPARK).items()])


DOCS = "docs AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _docs_columns(DUCK).items()) + " FROM pages)"


def _queue_columns() -> dict[str, str]:
    return {"url": "CASE WHEN id % 10 = 3 THEN concat(url, '&extra=', id) ELSE url END", "status": "CASE id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued' WHEN 2 THEN 'error' WHEN 3 THEN '' ELSE 'hydrated' END", "discovered_from": "'seed'", "queue_id": "id"}


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where("id % 2 = 0 OR id % 10 = 3").select(*[F.expr(x).alias(c) for c, x in _queue_columns().items()])


QUEUE = "queue AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _queue_columns().items()) + " FROM docs WHERE id % 2 = 0 OR id % 10 = 3)"


def _text_columns() -> dict[str, str]:
    return {"doc_id": "doc_id", "host": "source", "url": f"concat('https://', source, '.example.com', {_case('doc_id % 16', PATHS)})", "text": f"concat({_case('doc_id % 12', SENTENCES)}, ' ', coalesce(text, ''))"}


def policy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one policy sentence in front."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[F.expr(x).alias(c) for c, x in _text_columns().items()])


TEXTS = "texts AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in _text_columns().items()) + " FROM documents)"


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of a URL: its user, with the event type as the content."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").alias("id"), F.concat(F.lit("https://host"), F.expr("user_id % 23").cast("string"), F.lit(".example.com/u/"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("created_at"), F.md5(F.col("event_type")).alias("content_hash"), F.col("event_type").alias("kind"), F.concat_ws(" ", F.lit("state is"), "event_type", F.lit("now")).alias("body"))


REVISIONS = "revisions AS (SELECT event_id AS id, concat('https://host', CAST(user_id % 23 AS VARCHAR), '.example.com/u/', CAST(user_id AS VARCHAR)) AS url, ts AS created_at, md5(event_type) AS content_hash, event_type AS kind, concat_ws(' ', 'state is', event_type, 'now') AS body FROM events)"


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
