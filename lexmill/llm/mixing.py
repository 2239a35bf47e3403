"""Operator 9, mixing sources to target weights: hierarchical budgeting.

Documents are leaves' rows in a tree domain - language - source. A leaf can give
its tokens ``max_epochs`` times; capacities add up towards the root. Budgets go
down: a node's budget is shared among its children by weight; a child that
cannot take its share takes its capacity, and what it leaves goes to its
siblings first (by weight, again up to capacity). Only what all siblings leave is
a shortage of their parent, which its own siblings take in the step above.
All of it is integer arithmetic over one row per node.

A leaf's budget is spent in epochs: whole ones give every document once; the last
one takes a prefix of the leaf's documents in an order seeded by the epoch, as
far as their tokens fit. The prefix is found without sorting the leaf: sums per
hash range (two levels of 256) find the one small range that the budget ends in, and only
that is ordered.

Only built-in functions run. Null domains, languages and sources are nodes of
their own. A null or empty text has no tokens and counts as fitting. Repeated
rows are repeated documents (ordered alike); a null doc_id hashes as ''. Every row gives a row; an empty table gives
none; columns of the same names as those added are replaced, others kept by ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, small_or_as_is, written

SEED, MAX_EPOCHS = 17, 2
#: The budget, in hundredths of all tokens.
PERCENT = 60
LEVELS = ("domain", "lang", "source")
# Fixed values of the registered query: target weights of domains and languages; others, and all sources, weigh 1.
DOMAINS = ("web", "books", "code", "reference")
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "code": 2, "reference": 1}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
_DIGITS = 15


def domain_of(source: Column) -> Column:
    """The registered query's rule: a source's trailing number deals it to a domain."""
    n = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.when(source.isNotNull(), F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), n % len(DOMAINS) + 1))


def weights_of(level: str) -> Column:
    table = {"domain": DOMAIN_WEIGHTS, "lang": LANGUAGE_WEIGHTS}.get(level, {})
    out = F.lit(1)
    for name, weight in table.items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_out(children: DataFrame, parent: list[str], own: str) -> DataFrame:
    """children: rows with ``budget`` of the parent, ``weight`` and ``capacity``; budget becomes each child's own."""
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col(own).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = children.withColumns({"taken": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    full = ranked.withColumn("full", F.col("capacity") * F.col("rest") <= F.col("weight") * (F.col("budget") - F.col("taken")))
    group = Window.partitionBy(*parent)
    left = full.withColumns({"free": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0)), "share": F.sum(F.when(~F.col("full"), F.col("weight"))).over(group), "upto": F.sum(F.when(~F.col("full"), F.col("weight"))).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    given = F.expr("(free * upto) div share - (free * (upto - weight)) div share")
    return left.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(given)).drop("taken", "rest", "full", "free", "share", "upto")


def budgets(leaves: DataFrame, total: Column, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves: domain, lang, source, tokens (one row each) -> with ``budget``."""
    capacity = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    root = capacity.agg(F.least(total, F.sum("capacity")).alias("budget"))
    nodes = None
    for depth, level in enumerate(LEVELS):
        above, keys = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        children = capacity.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weights_of(level))
        if depth == 0:
            children = children.crossJoin(F.broadcast(root)).withColumn("_root", F.lit(0))
            nodes = shared_out(children, ["_root"], level).drop("_root")
        else:
            parent = nodes.select(*[F.col(c).alias(f"p_{c}") for c in above], "budget")
            match = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in above]
            children = children.join(parent, match).drop(*[f"p_{c}" for c in above])
            nodes = shared_out(children, above, level)
    return nodes.select(*LEVELS, "budget")


def _draw(seed: int, epoch: Column, key: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long")


def mix(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS, percent: int = PERCENT, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, leaf_budget, copies (0: not selected) of every row."""
    named = docs.select("doc_id", (domain if domain is not None else domain_of(F.col("source"))).alias("domain"), "lang", "source", tokens_of(F.col("text")).alias("n_tokens"))
    measured = written(named)
    leaves = written(measured.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = written(leaves.join(budgets(leaves, F.lit(total * percent // 100), max_epochs).select(*[F.col(c).alias(f"b_{c}") for c in LEVELS], F.col("budget").alias("leaf_budget")), [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in LEVELS]).drop(*[f"b_{c}" for c in LEVELS]))
    spent = plan.select(*[F.col(c).alias(f"l_{c}") for c in LEVELS], F.struct(*LEVELS).alias("leaf"), "leaf_budget", F.expr("CASE WHEN tokens > 0 THEN leaf_budget div tokens ELSE 0 END").alias("epochs"), F.expr("CASE WHEN tokens > 0 THEN leaf_budget % tokens ELSE 0 END").alias("room"))
    joined = measured.join(small_or_as_is(spent), [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in LEVELS]).drop(*[f"l_{c}" for c in LEVELS])
    drawn = joined.withColumn("draw", _draw(seed, F.col("epochs"), F.col("doc_id")))
    byte = lambda k: F.expr(f"CAST((draw div {16 ** (_DIGITS - 2 * k)}) % 256 AS INT)")
    drawn = drawn.withColumns({"b1": byte(1), "b2": byte(2)})

    def cut(rows: DataFrame, at: str, before: Column) -> DataFrame:
        """The first range of a leaf whose sum passes its room, and the tokens before it."""
        sums = rows.groupBy("leaf", "room", at, before.alias("base")).agg(F.sum("n_tokens").alias("n"))
        order = Window.partitionBy("leaf").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        over = sums.withColumn("upto", F.col("base") + F.sum("n").over(order)).where("upto > room")
        return over.groupBy("leaf").agg(F.min_by(F.struct(F.col(at).alias(f"cut_{at}"), (F.col("upto") - F.col("n")).alias(f"sum_{at}")), at).alias("c")).select("leaf", "c.*")

    first = written(cut(drawn, "b1", F.lit(0)))
    once = drawn.join(small_or_as_is(first), "leaf", "left")
    second = written(cut(once.where("b1 = cut_b1"), "b2", F.col("sum_b1")))
    twice = once.join(small_or_as_is(second), "leaf", "left")
    ends = F.coalesce((F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2")), F.lit(False))
    order = Window.partitionBy("leaf").orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = twice.where(ends).withColumn("fits", F.col("sum_b2") + F.sum("n_tokens").over(order) <= F.col("room"))
    whole = twice.where(~ends).withColumn("fits", F.coalesce((F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("b2") < F.col("cut_b2"))), F.lit(False)))
    return whole.unionByName(last).select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", (F.col("epochs") + F.col("fits").cast("long")).alias("copies"))


def select(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS, percent: int = PERCENT, domain: Column | None = None) -> DataFrame:
    """The rows of documents that are selected, with all their columns, as often as they are.

    Only ids and numbers are compared; texts meet them in one join. Rows that share a
    doc_id are all given as often as the one of them that is selected most.
    """
    key, times, one = fresh(docs, "_id", "_copies", "_copy")
    chosen = mix(docs, seed, max_epochs, percent, domain).where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(times))
    kept = docs.join(small_or_as_is(written(chosen)), F.col("doc_id").eqNullSafe(F.col(key)))
    return kept.withColumn(one, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op9_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _case(level: str) -> str:
    table = {"domain": DOMAIN_WEIGHTS, "lang": LANGUAGE_WEIGHTS}.get(level, {})
    return "CAST(" + (f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END" if table else "1") + " AS BIGINT)"


def _level_sql(depth: int) -> str:
    level, above = LEVELS[depth], LEVELS[:depth]
    keys, part = ", ".join(LEVELS[: depth + 1]), f"PARTITION BY {', '.join(above)}" if above else ""
    source = "root" if not depth else f"n{depth - 1} p"
    on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM p.{k}" for k in above)
    join = f"CROSS JOIN {source}" if not depth else f"JOIN {source} ON {on}"
    budget = "root.budget" if not depth else "p.budget"
    order = f"ORDER BY capacity / weight, {level} NULLS FIRST"
    return f"""n{depth} AS (SELECT {keys}, CASE WHEN f THEN capacity ELSE (free * upto) // share - (free * (upto - weight)) // share END AS budget FROM (
  SELECT *, budget - coalesce(sum(CASE WHEN f THEN capacity END) OVER ({part}), 0) AS free, sum(CASE WHEN NOT f THEN weight END) OVER ({part}) AS share,
    sum(CASE WHEN NOT f THEN weight END) OVER ({part} {order} ROWS UNBOUNDED PRECEDING) AS upto FROM (
    SELECT *, capacity * rest <= weight * (budget - taken) AS f FROM (
      SELECT *, coalesce(sum(capacity) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(weight) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM (
        SELECT {", ".join(f"c.{k}" for k in LEVELS[: depth + 1])}, c.capacity, c.weight, {budget} AS budget FROM (SELECT {keys}, sum(tokens) * {MAX_EPOCHS} AS capacity, {_case(level)} AS weight FROM leaves GROUP BY {keys}) c {join})))))"""


ORACLE = f"""
WITH named AS (SELECT doc_id, [{", ".join(f"'{d}'" for d in DOMAINS)}][CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % {len(DOMAINS)} + 1] AS domain, lang, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM named GROUP BY ALL),
root AS (SELECT least((SELECT sum(tokens) FROM leaves) * {PERCENT} // 100, sum(tokens) * {MAX_EPOCHS}) AS budget FROM leaves),
{_level_sql(0)}, {_level_sql(1)}, {_level_sql(2)},
spent AS (SELECT l.*, b.budget AS leaf_budget, CASE WHEN tokens > 0 THEN b.budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN b.budget % tokens ELSE 0 END AS room
  FROM leaves l JOIN n2 b ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
drawn AS (SELECT n.*, leaf_budget, epochs, room, md5(concat_ws(':', '{SEED}', CAST(epochs AS BIGINT), doc_id)) AS draw FROM named n JOIN spent s ON n.domain IS NOT DISTINCT FROM s.domain AND n.lang IS NOT DISTINCT FROM s.lang AND n.source IS NOT DISTINCT FROM s.source),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(draw, 1, {_DIGITS}), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM drawn)
SELECT doc_id, domain, lang, source, n_tokens, CAST(leaf_budget AS BIGINT) AS leaf_budget, CAST(epochs + CASE WHEN upto <= room THEN 1 ELSE 0 END AS BIGINT) AS copies FROM summed
"""
