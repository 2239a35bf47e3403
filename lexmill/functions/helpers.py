"""The small helpers that built-in expressions cannot replace: Arrow batches in, Arrow batches out."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher, ndiff, unified_diff
from itertools import islice
from urllib.parse import urldefrag, urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import markup
from . import rules as R
from .stemmer import stem


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Every HTML entity resolved."""
    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(ArrayType(StringType()))
def unescaped_each(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else [html.unescape(r) for r in x])


#: What ``html.unescape`` looks at, one reference after the other.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def with_unescaped(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Adds columns with every HTML entity resolved. Only the references leave the JVM, not the texts between them, so Python's share of a batch of rows stays small."""
    raw = df.withColumns(parts)
    found = raw.withColumns({f"_{k}_refs": F.when(F.col(k).contains("&"), F.regexp_extract_all(k, F.lit(REFERENCE), 0)) for k in parts})
    known = found.withColumns({f"_{k}_refs": unescaped_each(F.when(F.size(f"_{k}_refs") > 0, F.col(f"_{k}_refs"))) for k in parts})

    def whole(k: str) -> Column:
        between = F.split(k, REFERENCE)
        return F.coalesce(F.array_join(F.zip_with(between, f"_{k}_refs", lambda text, ref: F.concat(text, F.coalesce(ref, F.lit("")))), ""), F.col(k))

    return known.withColumns({k: whole(k) for k in parts}).drop(*[f"_{k}_refs" for k in parts])


@F.pandas_udf(StringType())
def joined_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """U7 with ``..`` segments: absolute and without fragment."""
    return pd.Series([None if b is None or h is None or re.match(r"(?i)\s*(javascript:|mailto:|#)", h) else urldefrag(urljoin(b, h.strip()))[0] for b, h in zip(base, href, strict=True)])


@F.pandas_udf(StringType())
def blake2b160(s: pd.Series) -> pd.Series:
    """The 20-byte hash of normalized documents."""
    return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=20).hexdigest())


def simhash_of(text: str, ngram: int = 3, bits: int = 128) -> str:
    """Weighted votes of hashed word n-grams; a bit is set at a vote of 0 or more."""
    if not text:
        return "0" * (bits // 4)
    words = re.findall(r"[A-Za-z0-9_]+", text.lower())
    grams = Counter(" ".join(words[k : k + ngram]) for k in range(max(1, len(words) - ngram + 1)))
    votes, each = np.zeros(bits), iter(grams.items())
    while block := list(islice(each, GRAMS)):  # sums of whole numbers, exact in doubles
        raw = b"".join([hashlib.blake2b(g.encode(), digest_size=bits // 8).digest() for g, _ in block])
        set_ = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(block), -1), axis=1).astype(np.float64)
        counts = np.array([n for _, n in block], np.float64)
        votes += 2 * (counts @ set_) - counts.sum()
    return np.packbits(votes >= 0).tobytes().hex()


#: n-grams whose bits are counted at a time, and texts of a batch that are Python strings at a time.
GRAMS, ROWS = 1024, 64


def few_at_once(s: pa.Array, value, kind: pa.DataType) -> pa.Array:
    """``value`` of every text (or None); a batch stays in Arrow's form, and only ROWS texts and results are Python's."""
    parts = [pa.array([value(x) for x in s.slice(k, ROWS).to_pylist()], kind) for k in range(0, len(s), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(StringType())
def simhash(s: pa.Array) -> pa.Array:
    return few_at_once(s, lambda x: simhash_of(x or ""), pa.string())


#: Longer texts are compared in windows of so many tokens.
WINDOW = 200


def _changed_tokens(x: list[str], y: list[str]) -> Iterator[str]:
    """What ``ndiff`` marks as added or removed, as it is asked for. Of longer texts equal stretches are skipped, and windows that begin at a change are compared up to the last place where they meet again."""
    if max(len(x), len(y)) <= WINDOW:
        yield from (t for t in ndiff(x, y) if t[:2] in ("+ ", "- "))
        return
    i = j = 0
    while i < len(x) or j < len(y):
        while i < len(x) and j < len(y) and x[i] == y[j]:
            i, j = i + 1, j + 1
        a, b = x[i : i + WINDOW], y[j : j + WINDOW]
        if i + WINDOW < len(x) or j + WINDOW < len(y):
            meet = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
            if meet:
                a, b = a[: meet[-1].a + meet[-1].size], b[: meet[-1].b + meet[-1].size]
        yield from (t for t in ndiff(a, b) if t[:2] in ("+ ", "- "))
        i, j = i + len(a), j + len(b)


def tiny_diff_of(x: str | None, y: str | None, most: int = 280) -> str:
    x, y = (x or "").split(), (y or "").split()
    if not x or not y or x == y:
        return ""
    out, size = [], 0
    for t in _changed_tokens(x, y):
        out.append(t)
        size += len(t) + 1
        if size > most + 1:
            break
    return " ".join(out)[:most]


@F.pandas_udf(StringType())
def tiny_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """D3: added and removed tokens, at most 280 characters; nothing is compared beyond them."""
    return pd.Series([tiny_diff_of(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """A unified diff."""
    return pd.Series(["\n".join(unified_diff((x or "").splitlines(), (y or "").splitlines(), "old", "new", lineterm="")) for x, y in zip(a, b, strict=True)])


@F.arrow_udf(ArrayType(StringType()))
def stemmed_each(s: pa.Array) -> pa.Array:
    """Arrays of words, none null, as arrays of stems; each word of a batch is stemmed once."""
    words = s.flatten().dictionary_encode()
    stems = pa.array([stem(t) for t in words.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(np.concatenate([[0], s.value_lengths().to_numpy(zero_copy_only=False)])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), stems.take(words.indices))


@F.pandas_udf(StringType())
def without_blobs(s: pd.Series) -> pd.Series:
    """Object blobs of user interfaces, nested to any depth, cut out."""
    return s.map(lambda x: None if x is None else markup.without_blobs(x, R.BLOB_KEYS))
