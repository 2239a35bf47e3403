"""Operator 2, quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets integer measures (rates). Per language and
source a sketch of each measure counts values in buckets that keep DIGITS binary digits
(relative error under 1/128). Counts of sketches add up, so partial sketches merge in any
order and give the same result after a lost executor. Documents that fail the base rule are not counted.

A group's sketch is blended with its language's as if the language gave it PRIOR more documents,
and a language's with that of all in the same way: small groups lean on their language, large ones on
themselves, without a step between. Many documents have none of what a measure counts (no symbol, no equal line), so
the zeros are kept apart: from the values above zero come an upper quantile and ``reach`` times its distance from their
median (LEVELS), and the fence is that sum times the share of documents above zero. Where few show the measure at all, little
of it is odd; where all do, the fence is the plain one; in between it moves with the share, without a step. No cutoff in a measure's own unit
takes part. The fences are joined to the measures, and a document whose bucket is beyond any fence is not kept;
one that is at a fence (ties too) is.

Only built-in functions run. Repeated windows are found inside a row: by
their hashes (64 bits), sorted with their places only where some hash repeats, so a very long text takes n log n.

Null texts have no words, and fail the base rule. Null languages and sources are groups of their own.
Every row gives a row (repeated rows too); an empty table gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import let, written

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: The measures, each with the percent of its upper quantile above zero, and the reach beyond it in distances from the median.
LEVELS = {"symbol_rate": (90, 1), "line_rate": (99, 32), "repeat_rate": (99, 16), "word_length": (75, 8)}
#: Documents that a group's blend takes from the level above; parts that a document is counted in.
PRIOR, PARTS = 200, 1024
#: Binary digits that a bucket keeps.
DIGITS = 8
_SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of windows by place."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, n: a + n))

    return let(ranked, repeated)


def _repeat_words(words: Column) -> Column:
    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))

    return let(words, lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h))))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base columns of every row."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, _SPACES, "")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    found = docs.select("doc_id", "lang", "source", words.alias("words"), F.length(bare).cast("long").alias("word_chars"), (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), let(lines, F.size).cast("long").alias("n_lines"))
    base = found.select("doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", _repeat_words(F.col("words")).alias("n_repeat_words"), "n_lines")
    return base.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def rates(base: DataFrame) -> DataFrame:
    per = lambda a, b, unit: F.when(F.col(b) == 0, F.lit(0).cast("long")).otherwise(F.expr(f"({unit} * {a}) div {b}"))
    return base.withColumns({"symbol_rate": per("n_symbols", "word_chars", 1000), "line_rate": per("n_dup_lines", "n_lines", 1000), "repeat_rate": per("n_repeat_words", "n_words", 1000), "word_length": per("word_chars", "n_words", 100)})


def bucket(value: Column) -> Column:
    """The least value of the sketch's bucket: the leading binary digits."""
    low = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    unit = F.pow(F.lit(2.0), low)
    return (F.floor(value / unit) * unit).cast("long")


def sketches(rated: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n, of documents that pass the base rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in LEVELS]))
    return rated.where(~F.col("base_failed")).select("lang", "source", pairs.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, groups: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The fence of each measure for each of the groups (lang, source), one row per group."""
    parts = sketch.select(F.struct("lang", "source").alias("leaf"), F.struct("lang").alias("tongue"), "measure", "bucket", "n")
    leaves = groups.select(F.struct("lang", "source").alias("leaf"), F.struct("lang").alias("tongue")).distinct()

    def blend(above: DataFrame, key: str) -> DataFrame:
        """above: key, measure, bucket, weight of the level above, for each key -> weight of the blend."""
        own = parts.groupBy(key, "measure", "bucket").agg(F.sum("n").alias("n"))
        total = F.sum("weight").over(Window.partitionBy(key, "measure"))
        return above.join(own, [key, "measure", "bucket"], "left").withColumn("total", total).withColumn("weight", PARTS * F.coalesce("n", F.lit(0)) + F.expr(f"({prior * PARTS} * weight) div greatest(total, 1L)")).drop("n", "total")

    top = parts.groupBy("measure", "bucket").agg(F.sum("n").alias("weight"))
    tongues = leaves.select("tongue").distinct().withColumn("measure", F.explode(F.array(*map(F.lit, LEVELS))))
    leaf = blend(leaves.join(blend(tongues.join(top, "measure"), "tongue"), "tongue").drop("tongue"), "leaf")
    whole = Window.partitionBy("leaf", "measure")
    order = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    told = leaf.withColumn("of_all", F.sum("weight").over(whole)).where("bucket > 0")
    ranked = told.withColumns({"below": F.sum("weight").over(order), "total": F.sum("weight").over(whole)})
    setting = lambda k: F.create_map(*[F.lit(x) for m, v in LEVELS.items() for x in (m, v[k])])[F.col("measure")]
    at = lambda percent: F.min(F.when(100 * F.col("below") >= percent * F.col("total"), F.col("bucket")))
    ends = ranked.groupBy("leaf", "measure").agg(at(setting(0)).alias("high"), at(F.lit(50)).alias("mid"), F.max("total").alias("told"), F.max("of_all").alias("of_all"))
    plain = F.col("high") + setting(1) * (F.col("high") - F.col("mid"))
    fence = F.call_function("div", F.col("told") * plain, F.greatest("of_all", F.lit(1)))
    return ends.groupBy("leaf").agg(*[F.max(F.when(F.col("measure") == m, fence)).alias(f"{m}_fence") for m in LEVELS])


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Base columns, measures' fences and the verdict of every row."""
    rated = written(rates(measures(docs)))
    limits = fences(sketches(rated), rated, prior).select(*[F.col(f"{m}_fence") for m in LEVELS], F.col("leaf.lang").alias("g_lang"), F.col("leaf.source").alias("g_source"))
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for m in LEVELS:
        inside = inside & F.coalesce(bucket(F.col(m)) <= F.col(f"{m}_fence"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_METRIC_SQL = {
    "symbol_rate": "CASE WHEN word_chars = 0 THEN 0 ELSE (1000 * n_symbols) // word_chars END",
    "line_rate": "CASE WHEN n_lines = 0 THEN 0 ELSE (1000 * n_dup_lines) // n_lines END",
    "repeat_rate": "CASE WHEN n_words = 0 THEN 0 ELSE (1000 * n_repeat_words) // n_words END",
    "word_length": "CASE WHEN n_words = 0 THEN 0 ELSE (100 * word_chars) // n_words END",
}


def _bucket_sql(v: str) -> str:
    return f"CAST(({v} >> greatest(length(bin({v})) - {DIGITS}, 0)) << greatest(length(bin({v})) - {DIGITS}, 0) AS BIGINT)"


def _blend_sql(above: str, keys: str) -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM o.{k}" for k in keys.split(", "))
    return f"""SELECT {", ".join(f"a.{k}" for k in keys.split(", "))}, a.measure, a.bucket, {PARTS} * coalesce(o.n, 0) + ({PRIOR * PARTS} * a.weight) // sum(a.weight) OVER (PARTITION BY {", ".join(f"a.{k}" for k in keys.split(", "))}, a.measure) AS weight
  FROM ({above}) a LEFT JOIN (SELECT {keys}, measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL) o ON {on} AND a.measure = o.measure AND a.bucket = o.bucket"""


def _setting_sql(k: int) -> str:
    return "CASE measure " + " ".join(f"WHEN '{m}' THEN {v[k]}" for m, v in LEVELS.items()) + " END"


ORACLE = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
places AS (SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM split WHERE len(words) >= {WINDOW}),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS n FROM places),
covered AS (SELECT r, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM windows WHERE n > 1) GROUP BY r),
base AS (SELECT s.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM split s LEFT JOIN covered USING (r)),
failed AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed, {", ".join(f"{e} AS {m}" for m, e in _METRIC_SQL.items())} FROM base),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM failed WHERE NOT base_failed" for m in LEVELS)}),
sketch AS (SELECT lang, source, measure, {_bucket_sql("v")} AS bucket, count(*) AS n FROM long GROUP BY ALL),
top AS (SELECT measure, bucket, sum(n) AS weight FROM sketch GROUP BY ALL),
tongue AS ({_blend_sql("SELECT lang, top.* FROM (SELECT DISTINCT lang FROM failed), top", "lang")}),
leaf AS ({_blend_sql("SELECT g.lang, g.source, t.measure, t.bucket, t.weight FROM (SELECT DISTINCT lang, source FROM failed) g JOIN tongue t ON g.lang IS NOT DISTINCT FROM t.lang", "lang, source")}),
told AS (SELECT * FROM (SELECT *, sum(weight) OVER (PARTITION BY lang, source, measure) AS of_all FROM leaf) WHERE bucket > 0),
ranked AS (SELECT *, sum(weight) OVER (PARTITION BY lang, source, measure ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS below, sum(weight) OVER (PARTITION BY lang, source, measure) AS total FROM told),
ends AS (SELECT lang, source, measure, min(CASE WHEN 100 * below >= {_setting_sql(0)} * total THEN bucket END) AS high, min(CASE WHEN 100 * below >= 50 * total THEN bucket END) AS mid, max(total) AS told, max(of_all) AS of_all FROM ranked GROUP BY ALL),
fences AS (SELECT lang, source, {", ".join(f"max(CASE WHEN measure = '{m}' THEN (told * (high + {v[1]} * (high - mid))) // greatest(of_all, 1) END) AS {m}_fence" for m, v in LEVELS.items())} FROM ends GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {" AND ".join(f"coalesce({_bucket_sql(m)} <= {m}_fence, true)" for m in LEVELS)}) AS kept
FROM failed d LEFT JOIN fences f ON d.lang IS NOT DISTINCT FROM f.lang AND d.source IS NOT DISTINCT FROM f.source
"""
