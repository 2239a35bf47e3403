"""HTML to text, sections and links, as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import helpers as H
from ..functions import markup as M
from ..functions import rules as R
from ..functions import texts as T
from ..functions import urls as U
from ..functions.dialect import SPARK, column
from .joins import keep_urls, sanitized_urls


def _resolved(docs: DataFrame, parts: dict[str, Column], entities: str) -> DataFrame:
    """Adds columns with entities resolved: ``all``, also those without a semicolon, or the ``common`` ones of ``texts.unescape`` as the SQL of the queries does."""
    if entities == "all":
        return H.with_unescaped(docs, parts)
    return docs.withColumns(parts).withColumns({k: column(T.unescape, k) for k in parts})


def smart_clean(docs: DataFrame, min_chars: int = 120, big_html: int = 5000, mode: str = "full", entities: str = "all") -> DataFrame:
    """Adds clean_text and strategy; ``salvage`` cleans only rows without clean text. The shared first step is computed once."""
    if mode == "salvage":
        docs = docs.where("length(coalesce(clean_text, '')) = 0")
    common = docs.withColumn("_common", column(T.clean_common, "coalesce(body, '')"))
    big = F.length(F.coalesce("body", F.lit(""))) >= big_html
    raw = _resolved(common, {"_a": column(T.before_aggressive, "_common"), "_l": column(T.before_lenient, "_common"), "_f": F.when(big, column(T.before_fallback, "_common"))}, entities)
    both = raw.withColumns({"_a": column(T.after_markup, "_a"), "_l": column(T.after_markup, "_l"), "_f": column(T.after_fallback, "_f")})
    strategy = F.when(F.length("_a") >= min_chars, "aggressive").when(F.length("_l") >= min_chars, "lenient").when(big, "fallback").otherwise("best-effort")
    marked = both.withColumn("strategy", strategy)
    best = F.when(F.length("_l") > F.length("_a"), F.col("_l")).otherwise(F.col("_a"))
    text = F.when(F.col("strategy") == "aggressive", F.col("_a")).when(F.col("strategy") == "lenient", F.col("_l")).when(F.col("strategy") == "fallback", F.col("_f")).otherwise(best)
    return marked.withColumn("clean_text", text).drop("_common", "_a", "_l", "_f")


def strip_html_keep_text(docs: DataFrame, html: str = "body", out: str = "text", entities: str = "all") -> DataFrame:
    """Adds the text of a page in one line."""
    return _resolved(docs, {out: column(T.before_strip, html)}, entities).withColumn(out, column(T.after_strip, out))


def html_to_text(docs: DataFrame, html: str = "body", out: str = "text", entities: str = "all") -> DataFrame:
    """Adds the text of a page in trimmed lines, each whole."""
    return _resolved(docs, {out: column(T.before_text, html)}, entities).withColumn(out, column(T.after_text, out))


def pick_text(docs: DataFrame, entities: str = "all") -> DataFrame:
    """Adds text and source. Pages are read only where no clean text exists."""
    clean = F.trim(F.coalesce("clean_text", F.lit("")))
    has_body = F.trim(F.coalesce("body", F.lit(""))) != ""
    read = html_to_text(docs.withColumn("_page", F.when((clean == "") & has_body, F.col("body"))), "_page", "_text", entities)
    return read.withColumns({"source": F.when(clean != "", "clean").when(has_body, "body-fallback").otherwise("none"), "text": F.when(clean != "", clean).when(has_body, F.col("_text")).otherwise("")}).drop("_page", "_text")


def _per_page(docs: DataFrame, schema: str, types: list[pa.DataType], names: list[str], value) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [value(x) for x in batch.column("body").to_pylist()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *names])

    return docs.select("id", "body").mapInArrow(run, schema)


def extract_main_text(docs: DataFrame) -> DataFrame:
    """C5."""
    return _per_page(docs, "id long, main_text string", [pa.string()], ["main_text"], lambda x: (M.main_text_of(x),))


def extract_title_body(docs: DataFrame) -> DataFrame:
    """C6."""
    return _per_page(docs, "id long, page_title string, page_body string", [pa.string(), pa.string()], ["page_title", "page_body"], M.title_body_of)


_SECTION = pa.struct([("title", pa.string()), ("text", pa.string()), ("anchors", pa.list_(pa.string()))])


def html_to_sections(docs: DataFrame) -> DataFrame:
    """One array of sections per page."""
    return _per_page(docs, "id long, sections array<struct<title:string,text:string,anchors:array<string>>>", [pa.list_(_SECTION)], ["sections"], lambda x: (M.sections_of(x),))


def normalize_documents(docs: DataFrame) -> DataFrame:
    """Nested records of sections, topics and hash; jurisdiction defaults to global, the version is that of the fetch (or of now)."""
    parsed = html_to_sections(docs)
    blob = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("# "), s["title"], F.lit("\n"), s["text"])), "\n\n")
    fetched = F.coalesce(*([F.col("fetched_at").cast("timestamp")] if "fetched_at" in docs.columns else []), F.current_timestamp())
    joined = docs.select("id", "url", "doc_type", "jurisdiction", F.col("title").alias("source_name"), F.date_format(fetched, "yyyy-MM-dd'T'HH:mm:ss").alias("version_date")).join(parsed.withColumn("_blob", blob), "id")
    return joined.select(
        "id",
        "url",
        "source_name",
        F.coalesce("doc_type", F.lit("other")).alias("doc_type"),
        F.coalesce(F.nullif(F.trim("jurisdiction"), F.lit("")), F.lit("global")).alias("jurisdiction"),
        F.lit(None).cast("string").alias("effective_date"),
        "version_date",
        "sections",
        column(T.tag_topics, "_blob").alias("topics"),
        F.array().cast("array<string>").alias("penalties"),
        F.lit("").alias("appeals"),
        H.blake2b160("_blob").alias("hash"),
    )


def extract_links(docs: DataFrame, cap: int = 50, synthetic: bool = True) -> DataFrame:
    """(page_url, link, position): anchors resolved, kept if they look like policy pages, then the well-known paths; each link once per page, at most cap."""
    href = F.expr(SPARK.extract_all("coalesce(body, '')", r"""(?i)<a\b[^>]*?href=["']([^"']*)["']""", 1))
    dotted = F.col("href").rlike(r"(^\s*|/)[.]{1,2}(/|$|[?#])")  # only these leave the JVM
    link = F.coalesce(H.joined_url(F.when(dotted, F.col("url")), F.when(dotted, F.col("href"))), column(U.resolve_link, "url", "href"))
    own = docs.select("url", F.posexplode(href).alias("k", "href")).select("url", "k", link.alias("link"))
    found = own.where("link IS NOT NULL").where(column(U.link_filter, "link", kind="keywords"))
    if synthetic:
        site = F.concat(column(U.scheme, "url"), F.lit("://"), column(U.netloc, "url"))
        extra = docs.select("url", site.alias("_site"), F.posexplode(F.array(*[F.lit(p) for p in R.LIKELY_PATHS])).alias("k", "path")).select("url", (F.col("k") + 1_000_000).alias("k"), F.concat("_site", "path").alias("link"))
        found = found.unionByName(extra)
    once = found.groupBy("url", "link").agg(F.min("k").alias("k"))
    order = F.row_number().over(Window.partitionBy("url").orderBy("k", "link"))
    return once.withColumn("position", order).where(F.col("position") <= cap).select(F.col("url").alias("page_url"), "link", "position")


def extract_raw_links(docs: DataFrame, cap: int = 0) -> DataFrame:
    """(page_url, link, position) of the absolute URLs that stand anywhere in a page, sanitised and kept by F3 for the page's host; each link once a page, in the order of first appearance."""
    raw = F.expr(SPARK.extract_all("coalesce(body, '')", R.ABSOLUTE_URL, 0))
    found = docs.select(F.col("url").alias("page_url"), column(U.host_of, "url").alias("root"), F.posexplode(raw).alias("k", "url"))
    kept = keep_urls(sanitized_urls(found).select("page_url", "root", "k", F.col("clean").alias("url")), "url", "root").where("keep")
    once = kept.groupBy("page_url", F.col("url").alias("link")).agg(F.min("k").alias("k"))
    placed = once.withColumn("position", F.row_number().over(Window.partitionBy("page_url").orderBy("k", "link"))).drop("k")
    return placed.where(F.col("position") <= cap) if cap else placed


def sanitize_report_text(text: str):
    """Control characters, escaped JSON text, mojibake, object blobs of any depth, arrays and trailing brackets out; blank and doubled lines collapse. Only texts with braces leave the JVM."""
    x = F.regexp_replace(F.regexp_replace(F.col(text), "\r", "\n"), r"[\p{C}&&[^\n\t]]", "")
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\[nr]", "\n"), r"\\t", " "), r'\\"', '"')
    x = F.when(x.rlike(r'\\["nt]'), F.regexp_replace(escaped, r"\\\\(?!`)", r"\\")).otherwise(x)
    for bad, good in R.MOJIBAKE:
        x = F.replace(x, F.lit(bad), F.lit(good))
    for bad, good in R.GARBLED:
        x = F.regexp_replace(x, "(?U)" + bad, good)
    braces = F.when(x.contains("{") & x.contains("}"), x)
    x = F.coalesce(H.without_blobs(braces), x)
    for junk in (r'"\{[^{}]*\}"', r'\[\s*"\$"[^\]\n]*\]', r'"children"\s*:\s*\[[^\]]*\]', r"(?md)^\s*[{}]\s*$", r'["\\]{3,}'):
        x = F.regexp_replace(x, junk, "")
    ends = ((r"[\s,;:]*[\])}]+[\"“”'’]*[,;:]*\s*$", ""), (r"[\"“”'’]+[,;:]*\s*$", ""), (r"^\s*[\[({]+[\"“”'’]*\s*", ""))

    def line(ln: Column) -> Column:
        cut = ln
        for junk, by in ends:
            cut = F.regexp_replace(cut, junk, by)
        return F.trim(F.when(ln.rlike(r"^\s*\[\^\d+\]:\s*."), ln).otherwise(cut))

    whole = F.array_join(F.transform(F.split(x, "\n"), line), "\n")
    lines = F.split(F.regexp_replace(F.regexp_replace(whole, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), "\n")
    return F.array_join(F.element_at(F.transform(F.array(lines), lambda a: F.filter(a, lambda ln, k: (F.trim(ln) == "") | F.coalesce(F.trim(F.get(a, k - 1)) != F.trim(ln), F.lit(True)))), 1), "\n")
