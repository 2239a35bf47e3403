"""Searches against plain Python, and patterns behind the letters that they begin with."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions import helpers
from lexmill.functions.dialect import SPARK, beginning
from lexmill.operators import merge, search


def brute_snippet(text, terms, n):
    tokens = (text or "").split(" ")
    hit = [re.sub(r"[^\w]", "", t.lower()) in terms for t in tokens]
    best = max(range(len(tokens)), key=lambda i: (sum(hit[i : i + n]), -i))
    if not sum(hit[best : best + n]):
        return (text or "")[:280]
    shown = [f"[{t}]" if h else t for t, h in zip(tokens[best : best + n], hit[best : best + n], strict=True)]
    return (" … " if best else "") + " ".join(shown) + (" … " if best + n < len(tokens) else "")


def test_snippets_are_those_of_all_windows(spark):
    dice = random.Random(5)
    texts = [None, "", "the", "x " * 300] + [" ".join(dice.choice(["a", "b", "", "The,", "coo-kie", "c"]) for _ in range(dice.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for n in (1, 4, 10):
        got = [r.s for r in df.select("id", search.snippet("text", ["the", "cookie"], n).alias("s")).orderBy("id").collect()]
        assert got == [brute_snippet(t, ("the", "cookie"), n) for t in texts]
    plan = df.select(search.snippet("text", ["the"], 10).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # no sum for every token


def test_patterns_behind_their_letters(spark):
    assert [beginning(p) for p in (r"\bguidelines?\b", r"\bsection\s+\d+", "<", "(?i)x", "ab|c", r"a(b|c)", r"\badvertis(ing)s?")] == ["guideline", "section", "", "", "", "a", "advertis"]
    df = spark.createDataFrame([("some law, laws and LAW",), ("none",), (None,)], "x string")
    assert [r[0] for r in df.select(F.expr(SPARK.hits("x", r"\blaws?\b"))).collect()] == [2, 0, None]
    assert "contains" in SPARK.hits("x", r"\blaw\b")


def test_stems_and_chosen_terms_in_the_row(spark):
    df = spark.createDataFrame([(1, "Policies policy the policies"), (2, None)], "doc_id long, text string")
    got = search.build_index(df, "doc_id", stem=True)
    assert sorted((r.doc_id, r.term, r.tf, r.positions, r.doc_len) for r in got.collect()) == [(1, "polici", 3, [0, 1, 3], 4), (1, "the", 1, [2], 4)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    some = search.build_index(df, "doc_id", only=lambda t: t.startswith("pol"))
    assert sorted((r.term, r.positions, r.doc_len) for r in some.collect()) == [("policies", [0, 3], 4), ("policy", [1], 4)]


def test_few_texts_at_once():
    texts = ["x" * k for k in range(150)] + [None]
    assert helpers.few_at_once(pa.array(texts), lambda x: x, pa.string()).to_pylist() == texts
    assert helpers.few_at_once(pa.array([], pa.string()), len, pa.int64()).to_pylist() == []


def test_tags_are_found_once(spark):
    n = spark.sparkContext.accumulator(0)
    tags = spark.sparkContext.parallelize([(1, "a"), (2, "b"), (2, "a")], 1).map(lambda r: n.add(1) or r).toDF("doc_id long, tag string")
    ids, links = merge.build_tag_dictionary(tags)
    assert sorted(map(tuple, links.collect())) == [(1, 1), (2, 1), (2, 2)] and n.value == 3
