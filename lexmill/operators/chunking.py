"""Chunking of documents: sliding windows as expressions, greedy and structured splits as small helpers."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import rules as R
from ..functions import texts as T
from ..functions.dialect import column
from ..functions.helpers import few_at_once
from .joins import with_policy


def windows(text: str, max_chars: int | Column, overlap: int | Column, least: int, most: int = 0) -> Column:
    """Array of pieces: starts step by max - overlap (at least 1) until a window reaches the end; short pieces go."""
    size = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    step = F.greatest(size - overlap, F.lit(1))
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step))
    pieces = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.substring(F.col(text), k * step + 1, size))
    kept = F.filter(pieces, lambda p: F.length(p) >= least)
    return F.slice(kept, 1, most) if most else kept


def _exploded(docs: DataFrame, pieces: Column) -> DataFrame:
    out = docs.select("doc_id", "url", "host", F.posexplode(pieces).alias("chunk_index", "text"))
    return out.select("doc_id", "chunk_index", "text", F.length("text").cast("long").alias("char_len"), column(T.token_estimate, "text", how="floor").alias("token_estimate"), "url", "host")


def chunk_sliding(docs: DataFrame, max_chars: int = 800, overlap: int = 120, least: int = 120, most: int = 0, sizes: dict[str, tuple[int | None, int | None]] | None = None) -> DataFrame:
    """K3. ``sizes`` holds the (size, overlap) of hosts whose policy sets one of them."""
    if not sizes:
        return _exploded(docs.where("length(text) > 0"), windows("text", max_chars, overlap, least, most))

    def by_host(k: int, usual: int) -> Column:
        own = {h: v[k] for h, v in sizes.items() if v[k] is not None}
        listed = F.create_map(*[F.lit(x) for h, v in own.items() for x in (h.lower(), v)]) if own else None
        return F.lit(usual) if listed is None else F.coalesce(F.element_at(listed, F.lower("host")), F.lit(usual))

    return _exploded(docs.where("length(text) > 0"), windows("text", by_host(0, max_chars), by_host(1, overlap), least, most))


def chunk_by_policy(docs: DataFrame, policies: DataFrame, max_chars: int = 800, overlap: int = 120, least: int = 120, most: int = 0) -> DataFrame:
    """K3 with the size and overlap of each URL's policy (J6), where it sets them."""
    hosted = with_policy(docs.where("length(text) > 0"), policies)
    sized = hosted.withColumns({"_size": F.coalesce("policy.chunking.size", F.lit(max_chars)), "_overlap": F.coalesce("policy.chunking.overlap", F.lit(overlap))})
    return _exploded(sized, windows("text", F.col("_size"), F.col("_overlap"), least, most))


def greedy(text: str, size: int, least: int, overlap: int) -> list[str]:
    """K1: each window ends at its last break of the best kind; the next begins ``overlap`` before its end, but always later than this one."""
    out: list[str] = []
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end - at >= least:
            for mark in R.BREAKS:
                found = text.rfind(mark, at + least, end)
                if found >= 0:
                    end = found + (len(mark) if mark.strip() else 0)
                    break
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= n:
            break
        at = max(end - overlap, at + 1)
    if len(out) > 1 and len(out[-1]) < max(1, least // 2):
        tail = out.pop()
        out[-1] = f"{out[-1]}\n\n{tail}"
    return out


_HEADING = re.compile(R.HEADING, re.I)
_SENTENCE = re.compile(R.SENTENCE_END)


def structured(text: str, size: int, least: int, overlap: int) -> list[str]:
    """K2: sentences of paragraphs of heading blocks, packed up to size; longer sentences are cut; each chunk but the first may carry the end of the one before, with what that one carries."""
    blocks: list[list[str]] = [[]]
    for line in re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"\r\n?", "\n", text))).strip().split("\n"):
        if _HEADING.match(line) and blocks[-1]:
            blocks.append([])
        blocks[-1].append(line)
    parts = [s.strip() for b in blocks for p in re.split(r"\n\s*\n+", "\n".join(b)) for s in _SENTENCE.split(p) if s.strip()]
    packed: list[str] = []
    now = ""
    for s in parts:
        if len(s) > size:
            packed += [now] if now else []
            now, step = "", max(1, size - overlap)
            packed += [s[k : k + size].strip() for k in range(0, max(1, len(s) - overlap), step)]
        elif now and len(now) + 1 + len(s) > size:
            packed.append(now)
            now = s
        else:
            now = f"{now} {s}" if now else s
    packed += [now] if now else []
    packed = [re.sub(r"[ \t]+", " ", p).strip() for p in packed]
    out: list[str] = []
    for k, p in enumerate(packed):
        merged = f"{out[-1][-overlap:]} {p}".strip() if k and overlap else p
        out.append(merged if len(merged) <= int(1.15 * size) else p)
    return [p for p in out if len(p) >= least or len(out) == 1]


def _by(split: Callable[[str, int, int, int], list[str]], size: int, least: int, overlap: int):
    @F.arrow_udf(ArrayType(StringType()))
    def run(s: pa.Array) -> pa.Array:
        return few_at_once(s, lambda x: split(x or "", size, least, overlap), pa.list_(pa.string()))

    return run


def chunk_greedy(docs: DataFrame, size: int = 2200, least: int = 300, overlap: int = 250) -> DataFrame:
    """K1."""
    return _exploded(docs.where(F.length("text") >= least // 2), _by(greedy, size, least, overlap)("text"))


def chunk_structured(docs: DataFrame, size: int = 2200, overlap: int = 250, least: int = 100) -> DataFrame:
    """K2."""
    return _exploded(docs.where("length(text) > 0"), _by(structured, size, least, overlap)("text"))


def chunk_corpus(docs: DataFrame, existing: DataFrame, rechunk: bool = False, exclude_hosts: tuple[str, ...] = (), exclude_ids: tuple[int, ...] = (), policies: DataFrame | None = None, **options) -> DataFrame:
    """K4: existing chunks with those of documents that have none (or, with rechunk, all chunks anew), cut as ``policies`` say; other options, also per-host ``sizes``, go to ``chunk_sliding``."""
    cut = (lambda d: chunk_sliding(d, **options)) if policies is None else (lambda d: chunk_by_policy(d, policies, **options))
    todo = docs
    for h in exclude_hosts:
        todo = todo.where(~F.contains("host", F.lit(h.lower())))
    if exclude_ids:
        todo = todo.where(~F.col("doc_id").isin(list(exclude_ids)))
    if not rechunk:
        return existing.unionByName(cut(todo.join(existing.select("doc_id").distinct(), "doc_id", "left_anti")))
    return existing.join(todo.select("doc_id"), "doc_id", "left_anti").unionByName(cut(todo))
