"""Operator 12 against brute force: every period of every text, and the contract's digests."""

import hashlib
import random
import re
import zlib

import pytest

from lexmill.llm import periodic_runs


def brute_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def _fibonacci(n: int) -> list[str]:
    a, b = ["a"], ["b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def _texts(rng: random.Random) -> list[str]:
    kind, n = rng.randint(0, 7), rng.randint(0, 150)
    if kind == 0:
        return rng.choices("ab", k=n)
    if kind == 1:
        return rng.choices("abcdefghij", k=n)
    if kind == 2:
        w = rng.choices("abc", k=rng.randint(1, 40)) * rng.randint(2, 6)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcx")
        return w
    if kind == 3:  # periods inside periods
        return (["a", "b"] * rng.randint(1, 30) + ["a"] * rng.randint(0, 2)) * rng.randint(1, 3) + rng.choices("abc", k=rng.randint(0, 20))
    if kind == 4:
        return _fibonacci(200)[rng.randint(0, 50) :][:n]
    if kind == 5:
        return ["01"[i.bit_count() % 2] for i in range(n)]
    if kind == 6:
        return ["w"] * n
    x = rng.choices("ab", k=rng.randint(1, 6)) * rng.randint(2, 25)
    return rng.choices("abz", k=rng.randint(0, 5)) + (x + x[: rng.randint(0, len(x))]) * rng.randint(1, 3) + x[: rng.randint(0, 20)]


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    for _ in range(100):
        block = [_texts(rng) for _ in range(rng.randint(1, 8))]
        _, runs, kept = periodic_runs._searched([" ".join(w).encode() for w in block], 12)
        for w, got, left in zip(block, runs, kept, strict=True):
            want = brute_runs(w)
            assert sorted(map(tuple, got.tolist())) == want
            drop = {i for s, n, q in want for i in range(s + q, s + n)}
            assert left.decode() == " ".join(x for i, x in enumerate(w) if i not in drop)


def test_long_periods_and_large_texts():
    rng = random.Random(9)
    w = [str(rng.randint(0, 5000)) for _ in range(30_000)]
    for n in (60_000, 75_000, 100_000):
        _, runs, _ = periodic_runs._searched([" ".join((w * 4)[:n]).encode()], 12)
        assert runs[0].tolist() == [[0, n, 30_000]]
    _, runs, kept = periodic_runs._searched([b"a b " * 40_000, b"x"], 12)
    assert runs[0].tolist() == [[0, 80_000, 2]] and kept == [b"a b", b"x"]


def test_planted_documents_and_digests_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("the of and a in to is was it for".split(), k=rng.randint(0, 120))) if i % 7 else f" \t{i}\x0b\x0c a\xa0b é é\n") for i in range(150)]
    rows += [(None, "x " * 20), (7, None), (7, ""), (7, "y y " * 9), (30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(df))).collect()), key=repr)
    want, planted = [], 0
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
        left = " ".join(x for i, x in enumerate(w) if i not in drop)
        want.append((doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    assert got == sorted(want, key=repr) and planted > 5


def test_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x " * 12, "c"), (3, "y " * 11, "d")], "doc_id long, text string, runs string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(df).collect()}
    assert [len(got[k].runs) for k in (1, 2, None, 3)] == [0, 0, 1, 0] and got[None].collapsed == "x" and got[3].n_words == 11
    empty = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(df.limit(0))))
    assert empty.count() == 0 and empty.columns[:3] == ["doc_id", "n_runs", "start"]
    with pytest.raises(ValueError, match="12 words"):
        periodic_runs.periodic_runs(df, 4)
