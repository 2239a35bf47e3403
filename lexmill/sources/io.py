"""Sources and sinks: page corpora, seeds, catalogs, policies, sitemaps, robots files; CSV, JSON and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts as X
from ..functions import urls as U
from ..functions.dialect import SPARK, column
from ..operators.merge import first_per


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages (page_id, url, html) in the shape of documents."""
    return spark.read.parquet(path).select(F.col("page_id").alias("id"), "url", F.col("html").alias("body"))


def load_table(spark: SparkSession, url: str, table: str, column_: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """The same from a database, read in parts of a numeric column by as many tasks; filters and columns are pushed into the database.

    Without bounds the least and the greatest value are asked for first (one row). They only set the strides: rows outside them, and those
    without a value, are read too. Other options (driver, user, fetchsize) go to the reader.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column_:
        if bounds is None:
            row = reader.option("query", f"SELECT MIN({column_}) AS lo, MAX({column_}) AS hi FROM {table}").load().first()
            bounds = (int(row[0] or 0), int(row[1] or 0))
        reader = spark.read.format("jdbc").option("url", url).options(**options)
        reader = reader.option("partitionColumn", column_).option("lowerBound", bounds[0]).option("upperBound", bounds[1] + 1).option("numPartitions", parts)
    return reader.option("dbtable", table).load()


def load_seeds(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """A JSON map key -> [url]: sanitised, with a scheme, without a trailing slash, the first of equals. The file is one small document."""
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = maps.select(F.posexplode("m").alias("a", "key", "urls")).select("a", "key", F.posexplode("urls").alias("b", "raw"))
    if keys:
        rows = rows.where(F.col("key").isin(keys))
    clean = F.expr(U.sanitize_url(SPARK, "raw"))
    full = F.regexp_replace(F.when(clean.rlike("(?i)^https?://"), clean).otherwise(F.concat(F.lit("https://"), clean)), "/+$", "")
    return first_per(rows.where(clean != "").withColumn("url", full), ["url"], "a", "b").select("key", "url")


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """S3: a YAML list of entities with defaults; rows without name or home go. A configuration file, read where the driver runs."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or []
    rows = data.get("entities", []) if isinstance(data, dict) else data
    trim = lambda x: str(x).strip() if x is not None else ""
    out = [(trim(r.get("name")), trim(r.get("home")), trim(r.get("category")) or "other", trim(r.get("depth")) or "shallow", int(r.get("priority") or 5), [trim(j) for j in r.get("jurisdictions") or ["global"]]) for r in rows if trim(r.get("name")) and trim(r.get("home"))]
    return spark.createDataFrame(out, "name string, home string, category string, depth string, priority int, jurisdictions array<string>")


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """S3: label and domain CSV with a header."""
    return spark.read.option("header", True).csv(path)


_HYDRATION = "struct<render_on_status:array<int>,thin_html_min_text_chars:int,script_ratio_over:double,timeout_s:int,render_timeout_s:int,headers:map<string,string>>"
#: The whole record of a policy: the normalised lists first, then the nested parts as their files have them (null where a file is silent).
POLICY = (
    "host string, aliases array<string>, collapse_www boolean, strip_ports boolean, drop_fragments boolean, strip_params array<string>, allow_prefixes array<string>, deny_patterns array<string>, add_tags array<string>, "
    f"hydration {_HYDRATION}, cleaning struct<remove_selectors:array<string>,keep_main_like:array<string>>, chunking struct<size:int,overlap:int>, "
    "discovery struct<static_max:int,dyn_max:int,include_hosts:array<string>,sitemap_hints:array<string>>, backoff struct<base_seconds:double,jitter_seconds:double,on_429_multiplier:double>, "
    "tagging map<string,array<string>>, version string"
)


def _number(value, kind: type):
    return None if value is None else kind(value)


def policy_rows(records: list[dict]) -> list[tuple]:
    """Both spellings of the parameter and path lists are taken."""
    out = []
    for r in records:
        n, tags = r.get("normalization") or {}, r.get("tagging") or {}
        extra = [f"policy.{k}:{v}" for k, vs in tags.items() if k != "add" and isinstance(vs, list) for v in vs]
        h, c, k, d, b = (r.get(part) or {} for part in ("hydration", "cleaning", "chunking", "discovery", "backoff"))
        when = h.get("render_if") or {}
        out.append(
            (
                r["host"],
                r.get("aliases") or [],
                bool(n.get("collapse_www", True)),
                bool(n.get("default_port_strip", True)),
                bool(n.get("drop_fragments", True)),
                n.get("strip_params") or n.get("query_param_drops") or [],
                n.get("path_allow_prefixes") or [p.lstrip("^") for p in n.get("path_allow_regexes") or []],
                n.get("path_deny_regexes") or [],
                [*(tags.get("add") or []), *extra],
                ([int(x) for x in h.get("render_on_status") or []], _number(when.get("thin_html_min_text_chars"), int), _number(when.get("script_ratio_over"), float), _number(h.get("timeout_s"), int), _number(h.get("render_timeout_s"), int), {str(a): str(v) for a, v in (h.get("headers") or {}).items()}),
                (c.get("remove_selectors") or [], c.get("keep_main_like") or []),
                (_number(k.get("size"), int), _number(k.get("overlap"), int)),
                (_number(d.get("static_max"), int), _number(d.get("dyn_max"), int), d.get("include_hosts") or [], d.get("sitemap_hints") or []),
                (float(b.get("base_seconds", 0.3)), float(b.get("jitter_seconds", 0.0)), float(b.get("on_429_multiplier", 2.0))),
                {a: [str(v) for v in vs] for a, vs in tags.items() if isinstance(vs, list)},
                str(r.get("version") or "2025-08-31"),
            )
        )
    return out


def load_policies(spark: SparkSession, folder: str) -> DataFrame:
    """One YAML file per host; a ``default`` row is added if there is none. Configuration files, read where the driver runs."""
    from pathlib import Path

    import yaml

    records = [yaml.safe_load(p.read_text(encoding="utf-8")) or {} for p in sorted(Path(folder).glob("*.yml"))]
    records = [r for r in records if r.get("host")]
    if all(r["host"] != "default" for r in records):
        records.append({"host": "default"})
    return policies(spark, records)


def policies(spark: SparkSession, records: list[dict]) -> DataFrame:
    return spark.createDataFrame(policy_rows(records), POLICY)


def parse_sitemaps(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds kind (page or sitemap) and loc, a row for each; malformed files give what blocks they have whole."""
    blocks = F.expr(SPARK.extract_all(f"coalesce({xml}, '')", r"(?is)<(?:\w+:)?(?:url|sitemap)>.*?</(?:\w+:)?(?:url|sitemap)>", 0))
    found = df.select("*", F.explode(blocks).alias("_b"))
    kind = F.when(F.col("_b").rlike(r"(?i)^<(\w+:)?sitemap>"), "sitemap").otherwise("page")
    loc = F.regexp_extract("_b", r"(?is)<(?:\w+:)?loc>\s*([^<]+?)\s*</(?:\w+:)?loc>", 1)
    return found.withColumns({"kind": kind, "loc": loc}).where("loc <> ''").drop("_b")


def parse_robots_sitemaps(df: DataFrame, root: str = "root", robots: str = "robots") -> DataFrame:
    """The Sitemap lines, resolved against the root."""
    line = df.select(root, F.explode(F.split(robots, r"\r?\n")).alias("_l"))
    said = line.withColumn("_u", F.regexp_extract("_l", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1)).where("_u <> ''")
    return said.select(F.col(root).alias("root"), column(U.resolve_link, root, "_u").alias("sitemap"))


def ensure_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Adds what is missing with a type and a default; drops nothing."""
    missing = {f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def write_csv_report(df: DataFrame, path: str, files: int = 1) -> None:
    """Reports are small; one file unless told otherwise."""
    df.coalesce(files).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """S7."""
    df.write.mode("overwrite").json(path)


def export_snapshots(docs: DataFrame, domains: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(id, domain, slug, meta, html, text) of fetched legal pages that are no sitemap, robots file or asset."""
    domain, slug = U.domain_and_slug(SPARK, "url")
    kept = docs.where("status_code = 200 AND (length(coalesce(body, '')) > 0 OR length(coalesce(clean_text, '')) > 0)").where(column(U.is_legal_url, "url") & ~column(U.is_probably_asset, "url") & ~F.col("url").rlike(r"(?i)(sitemap|robots\.txt|\.xml(\.gz)?$)"))
    if domains:
        kept = kept.where(F.expr(domain).isin(domains))
    text = F.when(F.length(F.coalesce("clean_text", F.lit(""))) > 0, F.col("clean_text")).otherwise(column(X.quick_text, "body"))
    html = F.concat(F.lit("<!-- snapshot of "), F.col("url"), F.lit(" -->\n"), F.coalesce("body", F.lit("")))
    out = kept.select("id", F.expr(domain).alias("domain"), F.expr(slug).alias("slug"), F.to_json(F.struct("url", "status_code", "content_hash")).alias("meta"), html.alias("html"), text.alias("text"))
    return out.orderBy("id").limit(limit) if limit else out


def write_snapshots(snapshots: DataFrame, path: str, rows_per_file: int = 50_000) -> None:
    """In folders by domain, replacing the domains that come; others stay. Domains are counted first, and one of more rows than a file takes is dealt to as many tasks as it fills files."""
    counts = snapshots.groupBy("domain").count().where(F.col("count") > rows_per_file).select(F.col("domain").alias("_d"), F.ceil(F.col("count") / rows_per_file).alias("_files"))
    few = counts.limit(100_001).count() <= 100_000
    salted = snapshots.join(F.broadcast(counts) if few else counts, F.col("domain").eqNullSafe(F.col("_d")), "left").withColumn("_salt", F.pmod(F.xxhash64("id"), F.coalesce("_files", F.lit(1))))
    dealt = salted.repartition("domain", "_salt").select(*snapshots.columns)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("domain").parquet(path)
