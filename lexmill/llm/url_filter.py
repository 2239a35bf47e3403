"""Operator 10, URL filters: a ratio of character language models.

Rules decide the URLs that they fit. The URLs that rules accept and reject train
two smoothed variable-order Markov models: the next character given up to
ORDER characters before it, where each order is interpolated with the shorter one by Witten and
Bell's weights, down to equal chances. Other URLs are decided by the difference
of their log-likelihoods under the two models, divided by their length, against a threshold
calibrated half way between the mean scores of accepted and rejected training URLs.

Characters are folded to SYMBOLS classes, so at most SYMBOLS ** (ORDER + 1)
windows exist, whatever the input: every distinct window is scored once (in
integers, so sums do not depend on their order), and URLs join the scored windows. Rules are a short list
of literals. Only built-in functions run.

A null URL, or one without ``://``, has an empty host and path, which no rule
fits; its empty text is scored like any other. Without training URLs of both
kinds everything without a rule is allowed. Repeated rows and equal URLs get equal results; every row
gives a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_or_as_is, written

# The registered query's rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER, SYMBOLS, UNIT = 3, 34, 1_000_000
#: Distinct windows are broadcast up to this number of rows (of some 40 bytes); SYMBOLS ** 4 is the bound of all.
WINDOWS = 1_400_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, rule, verdict) of the longest fitting rule, or null."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def folded(text: Column) -> Column:
    """The text that models see: lower case, one class of digits, one of other characters."""
    lower = F.translate(text, _UPPER + "123456789", _LOWER + "0" * 9)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(lower, r"[^a-z0/._\-]", "~"), F.lit("$"))


def _windows(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - ORDER), lambda i: F.substring(text, i, F.lit(ORDER + 1)))


def scored_windows(texts: DataFrame) -> DataFrame:
    """texts: text, accepted, rejected (how often each was trained on, 0 if not) -> window, gain (in 1/UNIT nats)."""
    counts = written(texts.select(F.explode(_windows(F.col("text"))).alias("window"), "accepted", "rejected").groupBy("window").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")))
    scored = counts.select("window")
    chances = {"a": F.lit(1.0) / SYMBOLS, "r": F.lit(1.0) / SYMBOLS}
    for k in range(ORDER + 1):
        grams = counts.groupBy(F.substring("window", ORDER + 1 - k, k + 1).alias(f"g{k}")).agg(*[F.sum(m).alias(f"{m}{k}") for m in chances])
        contexts = grams.groupBy(F.substring(f"g{k}", 1, k).alias(f"c{k}")).agg(*[x for m in chances for x in (F.sum(f"{m}{k}").alias(f"{m}n{k}"), F.sum((F.col(f"{m}{k}") > 0).cast("long")).alias(f"{m}t{k}"))])
        scored = scored.withColumn(f"g{k}", F.substring("window", ORDER + 1 - k, k + 1)).join(grams, f"g{k}").withColumn(f"c{k}", F.substring(f"g{k}", 1, k)).join(contexts, f"c{k}")
        shorter, chances = chances, {}
        for m in shorter:
            n, t = F.col(f"{m}n{k}"), F.col(f"{m}t{k}")
            chances[m] = F.when(n == 0, shorter[m]).otherwise((F.col(f"{m}{k}") + t * shorter[m]) / (n + t))
        scored = scored.select("window", *[chances[m].alias(f"p_{m}") for m in chances])
        chances = {m: F.col(f"p_{m}") for m in chances}
    return scored.select("window", F.round((F.log("p_a") - F.log("p_r")) * UNIT).cast("long").alias("gain"))


def judge(pages: DataFrame, rules=RULES, whole: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, score (in 1/UNIT nats a character) of every row; the models see host and path, or the whole URL."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("url"))
    found = split.select("*", ruled(F.col("host"), F.col("path"), rules).alias("fit"), folded(F.col("url") if whole else F.concat("host", "path")).alias("text")).drop("url")
    texts = written(found.groupBy("text").agg(F.count_if(F.col("fit.verdict") == "allow").alias("accepted"), F.count_if(F.col("fit.verdict") == "block").alias("rejected")))
    gains = written(scored_windows(texts))
    each = texts.select("text", F.explode(_windows(F.col("text"))).alias("window")).join(small_or_as_is(gains, WINDOWS), "window")
    scores = written(each.groupBy("text").agg(F.sum("gain").alias("gain")).withColumn("score", F.expr(f"gain div (length(text) - {ORDER})")))
    means = scores.join(texts, "text").agg(*[x for m in ("accepted", "rejected") for x in (F.sum(F.col("score") * F.col(m)).alias(f"s_{m}"), F.sum(m).alias(f"n_{m}"))]).first()
    trained = means["n_accepted"] and means["n_rejected"]
    level = (means["s_accepted"] / means["n_accepted"] + means["s_rejected"] / means["n_rejected"]) / 2 if trained else None
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") < level, "block").otherwise("allow") if trained else F.lit("allow"))
    return found.join(scores.select("text", "score"), "text").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_url_filter_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With models of whole URLs: scheme, query and fragment too."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), whole=True)


def _chance(k: int, m: str) -> str:
    return f"CASE WHEN {m}n{k} = 0 THEN p_{m} ELSE ({m}{k} + {m}t{k} * p_{m}) / ({m}n{k} + {m}t{k}) END AS p_{m}"


def _order_sql(k: int) -> str:
    return f"""g{k} AS (SELECT substr(w, {ORDER + 1 - k}, {k + 1}) AS g, sum(a) AS a{k}, sum(r) AS r{k} FROM counts GROUP BY 1),
c{k} AS (SELECT substr(g, 1, {k}) AS c, sum(a{k}) AS an{k}, sum(r{k}) AS rn{k}, sum((a{k} > 0)::BIGINT) AS at{k}, sum((r{k} > 0)::BIGINT) AS rt{k} FROM g{k} GROUP BY 1),
s{k} AS (SELECT w, {_chance(k, "a")}, {_chance(k, "r")} FROM {f"s{k - 1}" if k else f"(SELECT w, 1.0::DOUBLE / {SYMBOLS} AS p_a, 1.0::DOUBLE / {SYMBOLS} AS p_r FROM counts)"} s JOIN g{k} ON substr(s.w, {ORDER + 1 - k}, {k + 1}) = g{k}.g JOIN c{k} ON substr(g{k}.g, 1, {k}) = c{k}.c)"""


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
_SORTED = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE = f"""
WITH rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
found AS (SELECT *, CASE {_FITS.format(*[f"'{h}{p}'" for h, p, _ in _SORTED])} END AS rule, CASE {_FITS.format(*[f"'{v}'" for _, _, v in _SORTED])} END AS fit,
  '{"^" * ORDER}' || regexp_replace(translate(host || path, '{_UPPER}123456789', '{_LOWER}000000000'), '[^a-z0/._\\-]', '~', 'g') || '$' AS text FROM split),
texts AS (SELECT text, count(*) FILTER (fit = 'allow') AS a, count(*) FILTER (fit = 'block') AS r FROM found GROUP BY text),
windows AS (SELECT text, a, r, substr(text, i, {ORDER + 1}) AS w FROM (SELECT text, a, r, unnest(range(1, length(text) - {ORDER - 1})) AS i FROM texts)),
counts AS (SELECT w, sum(a) AS a, sum(r) AS r FROM windows GROUP BY w),
{", ".join(_order_sql(k) for k in range(ORDER + 1))},
gains AS (SELECT w, CAST(round((ln(p_a) - ln(p_r)) * {UNIT}) AS BIGINT) AS gain FROM s{ORDER}),
scores AS (SELECT text, any_value(a) AS a, any_value(r) AS r, CAST(sum(gain) AS BIGINT) // (length(text) - {ORDER}) AS score FROM windows JOIN gains USING (w) GROUP BY text),
level AS (SELECT (CAST(sum(score * a) AS DOUBLE) / sum(a) + CAST(sum(score * r) AS DOUBLE) / sum(r)) / 2 AS level FROM scores)
SELECT page_id, host, path, rule, coalesce(fit, CASE WHEN score < level THEN 'block' ELSE 'allow' END) AS verdict, CAST(score AS BIGINT) AS score FROM found JOIN scores USING (text), level
"""
