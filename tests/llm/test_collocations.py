"""Operator 11 against its SQL, and against plain counting with other parameters and on odd rows."""

import random
import re
from collections import Counter

import pytest

from lexmill.llm import collocations
from tests.oracle import rows, sql_rows


def brute(docs, least, longest, most, percent=80):
    count, words = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            count.update((lang or "und", tuple(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    found = {p: a for p, a in count.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, w), a in found.items():
        if any(len(v) > len(w) and g == lang and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in found.items()):
            continue
        score, _, le, ri = min((2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), le, ri))
    return sorted((lang, rank, p.decode(), -a, le, ri, words[lang], -score) for lang, r in out.items() for rank, (score, a, p, le, ri) in enumerate(sorted(r)[:most], 1))


def _rows(df):
    return sorted(tuple(r[c] for c in "lang rank phrase a l r n score".split()) for r in df.collect())


def _documents(seed, n):
    rng = random.Random(seed)
    passage = " ".join(rng.choices("ALPHA beta gamma delta épsilon Zeta".split(), k=60))
    docs = []
    for k in range(n):
        w = rng.choices("the of and a in to is é É ü's w-1".split(), weights=range(11, 0, -1), k=rng.randint(0, 80))
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "\xa0"]) for x in w)
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text + (passage if k % 3 == 0 else "")))
    return [*docs, ("en", None), ("fr", ""), ("fr", "..."), ("en", "loop " * 3000), (None, "the of. the of, the of")]


@pytest.mark.parametrize(("seed", "least", "longest", "trigger", "bits"), [(1, 5, 4, 4, 1 << 20), (2, 3, 2, 2, 1 << 20), (3, 4, 5, 16, 64), (4, 2, 3, 1, 1 << 12)])
def test_against_plain_counting(spark, seed, least, longest, trigger, bits):
    docs = _documents(seed, 120)
    df = spark.createDataFrame([(k % 7, t, lang, "x") for k, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, chunk string").repartition(5)
    for most in (7, 100_000):
        got = collocations.collocations(df, least, longest, most, trigger=trigger, bits=bits)
        assert _rows(got) == brute(docs, least, longest, most)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(spark, collocations.op11_collocations, sf)
    assert got == sql_rows(collocations.ORACLE, sf) and len(got[1]) > 200


def test_equal_passages_become_equal_chunks(spark):
    rng = random.Random(8)
    passage = " ".join(f"w{rng.randint(0, 400)}" for _ in range(400))
    docs = [(1, "en", f"{' '.join(rng.choices('abcdefgh', k=rng.randint(1, 40)))} {passage} tail{k}") for k in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    chunks = collocations.dictionary(df).collect()
    assert sum(c.own * c.n for c in chunks) == sum(len(t.split()) for _, _, t in docs)
    assert sum(c.own for c in chunks if c.n == 50) > 300
