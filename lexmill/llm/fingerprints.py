"""Operator 3, document fingerprints: Order MinHash.

The k-mers of a text (K consecutive words; a shorter text is one k-mer) are
numbered by occurrence, so that repeats count, and hashed. One hash deals them
into SLOTS classes; in each the TUPLE least are taken, put back into their order in
the text and hashed together. A slot therefore agrees between two texts only if the same
k-mers were least and stand in the same order, which makes the share of
agreeing slots sensitive to edit distance, not only to shared content.

The fingerprint is a string of SLOTS groups of four hexadecimal digits; a slot
without k-mers is ``----``. Only built-in functions run; a text's k-mers stay
inside its row (arrays and sorts of n log n), and one shuffle, by ranges of doc_id, brings neighbours together.

A null text counts as empty; empty texts have empty slots only, and likeness 1
to each other, 0 to any other. Equal doc_ids follow each other in order of text; a
null doc_id comes last. A single row is its own next document. Every row gives a
row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import let

K, TUPLE, SLOTS, SLOT_BITS = 3, 2, 64, 6
ROWS_PER_RANGE, MOST_RANGES = 1024, 16384
EMPTY = "----"
_LAST = (1 << 63) - 1


def _kmers(words: Column) -> Column:
    return let(words, lambda w: F.transform(F.slice(w, 1, F.when(F.size(w) == 0, 0).otherwise(F.greatest(F.size(w) - (K - 1), F.lit(1)))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, K)])))


def _numbered(hashes: Column) -> Column:
    """Structs of a hash of (k-mer, occurrence) and the place; a first occurrence keeps the k-mer's hash."""

    def by_occurrence(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, k: F.when(F.coalesce(F.get(s, k - 1)["v"] != x["v"], F.lit(True)), k)), lambda k: k.isNotNull())
        occurrence = let(heads, lambda h: F.flatten(F.transform(h, lambda at, j: F.sequence(F.lit(0), F.coalesce(F.get(h, j + 1), F.size(s)) - at - 1))))
        return F.zip_with(s, occurrence, lambda x, o: F.struct(F.when(o == 0, x["v"]).otherwise(F.xxhash64(x["v"], o)).alias("v"), x["i"].alias("i")))

    placed = lambda h: F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), placed(h)).otherwise(let(F.sort_array(placed(h)), by_occurrence)))


def fingerprint(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    slot = lambda x: F.shiftrightunsigned(x["v"], 64 - SLOT_BITS).cast("int")
    least = let(F.sort_array(_numbered(_kmers(words))), lambda s: F.filter(s, lambda x, k: F.coalesce(slot(F.get(s, k - TUPLE)) != slot(x), F.lit(True))))

    def slots(c: Column) -> Column:
        heads = F.filter(F.transform(c, lambda x, k: F.when(F.coalesce(slot(F.get(c, k - 1)) != slot(x), F.lit(True)), k)), lambda k: k.isNotNull())

        def digits(h: Column, at: Column, j: Column) -> Column:
            group = F.slice(c, at + 1, F.coalesce(F.get(h, j + 1), F.size(c)) - at)
            ordered = F.sort_array(F.transform(group, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"))))
            code = F.aggregate(ordered, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x["v"]))
            return F.lower(F.lpad(F.hex(F.shiftrightunsigned(code, 48)), 4, "0"))

        of = let(heads, lambda h: F.map_from_arrays(F.transform(h, lambda at: slot(F.get(c, at))), F.transform(h, lambda at, j: digits(h, at, j))))
        return let(of, lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda b: F.coalesce(F.try_element_at(m, b), F.lit(EMPTY))), ""))

    return let(least, slots)


def likeness(a: Column, b: Column) -> Column:
    """The share of slots that agree, of those that are not empty in both."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.struct(F.substring(a, 4 * k + 1, F.lit(4)).alias("x"), F.substring(b, 4 * k + 1, F.lit(4)).alias("y")))
    used = F.filter(pairs, lambda p: ~((p["x"] == EMPTY) & (p["y"] == EMPTY)))
    return let(used, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.filter(u, lambda p: p["x"] == p["y"])) / F.size(u)))


def _array_of(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def _range_of(order: Column, firsts: list[int]) -> Column:
    """The number of the range that a key is in (firsts: sorted; a key below the first is in range 0), by two short searches."""
    width = max(1, round(len(firsts) ** 0.5))
    blocks = [firsts[k : k + width] for k in range(0, len(firsts), width)]
    upper = F.greatest(F.size(F.filter(_array_of([b[0] for b in blocks]), lambda x: x <= order)), F.lit(1))
    inside = F.expr("array(" + ",".join("array(" + ",".join(f"{v}L" for v in b) + ")" for b in blocks) + ")")
    return let(upper, lambda u: F.greatest((u - 1) * width + F.size(F.filter(F.element_at(inside, u), lambda x: x <= order)) - 1, F.lit(0)))


def with_next(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with the ``next_`` columns of the row that follows in ascending key; after the last comes the first.

    Rows are dealt into ranges of the key, whose first keys (at most MOST_RANGES
    numbers) the driver knows. The first rows of a range are also sent to the range before as guests,
    so that no window spans ranges.
    """
    order = F.coalesce(F.col(key), F.lit(_LAST))
    ordered = rows.withColumn("_order", order)
    ids = rows.select(order.alias("_order"))
    count = ids.count()
    if not count:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    n = max(1, min(MOST_RANGES, count // ROWS_PER_RANGE))
    cuts = ids.agg(F.percentile_approx("_order", [k / n for k in range(n)], 100 * n)).first()[0]
    cuts = sorted({int(c) for c in cuts})
    firsts = [r["m"] for r in ids.groupBy(_range_of(F.col("_order"), cuts).alias("r")).agg(F.min("_order").alias("m")).orderBy("m").collect()]
    own = _range_of(F.col("_order"), firsts)
    ranged = ordered.withColumn("_range", own)
    wrap = [F.struct(F.lit(len(firsts) - 1).alias("r"), F.lit(2).alias("guest"))]
    homes = F.when(F.col("_order") == firsts[0], F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), *wrap))
    starts = F.exists(_array_of(firsts), lambda x: x == F.col("_order")) if len(firsts) <= 64 else F.element_at(_array_of(firsts), F.col("_range") + 1) == F.col("_order")
    homes = homes.when(starts, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct((F.col("_range") - 1).alias("r"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest"))))
    dealt = ranged.withColumn("_home", F.explode(homes)).drop("_range")
    window = Window.partitionBy("_home.r").orderBy("_home.guest", "_order", *columns)
    return dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]).where("_home.guest = 0").drop("_home", "_order")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """The contract's rows: fingerprints of every text and of its edited text, and their likeness."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = text.withColumn("fingerprint", fingerprint(F.col("text")))
    both = with_next(marked, "doc_id", ["text", "fingerprint"])
    n = F.length("text").cast("long")
    moved = F.expr("CAST(length(text) div 4 AS INT)")
    edited = both.select("doc_id", n.alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.substring("text", F.lit(1), (F.length("text") - moved).cast("int")), F.substring("next_text", F.lit(1), moved)).alias("edited"))
    done = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
