"""Document and chunk tags as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions.dialect import SPARK, column
from .joins import untagged_chunks


def tag_documents(docs: DataFrame, policies: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """G1: distinct (doc_id, tag), of ``whole`` texts or of their beginnings; a document's tags are already a set, so nothing is shuffled unless policies add some."""
    tags = column(T.document_tags, "url", "text", whole=whole)
    if policies is not None:
        from .joins import with_policy

        docs = with_policy(docs, policies)
        tags = F.array_sort(F.array_distinct(F.concat(tags, F.transform(F.coalesce("policy.add_tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))))))
    return docs.select("doc_id", F.explode(tags).alias("tag"))


def tag_chunks(chunks: DataFrame, existing: DataFrame | None = None, min_score: float = 1.0) -> DataFrame:
    """(chunk_id, tag, score) of chunks without tags."""
    if existing is not None:
        chunks = untagged_chunks(chunks, existing)
    scored = F.array(*[F.struct(F.lit(t).alias("tag"), F.expr(f"CAST({hits} AS DOUBLE)").alias("score")) for t, hits in T.chunk_tags(SPARK, "text")])
    return chunks.select("chunk_id", F.explode(scored).alias("x")).select("chunk_id", "x.tag", "x.score").where(F.col("score") >= min_score)
