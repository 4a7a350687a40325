"""Chunks, postings, keyword, vector and fused search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import scalars
from threadloom.operators.chunks import chunk_messages  # noqa: F401
from threadloom.operators.text_index import TextIndex, bm25, build_index, build_postings, query_phrases, read_index, write_index  # noqa: F401


def candidates_of(limit: int) -> int:
    return min(4 * limit, 200)


def neighbours_of(limit: int) -> int:
    return min(max(8 * limit, 20), 200)


def search_scope(df: DataFrame, conv: str | None = None, sender: str | None = None, after: int | None = None, before: int | None = None) -> DataFrame:
    """Chunks of a conversation, with a sender, that overlap a span of time."""
    if conv is not None:
        df = df.filter(F.col("conv_id") == conv)
    if sender is not None:
        df = df.filter(F.array_contains("sender_ids", sender))
    if after is not None:
        df = df.filter(F.col("end_time") >= after)
    return df if before is None else df.filter(F.col("start_time") <= before)


def exact_search(chunks: DataFrame, q: str, limit: int, **scope) -> DataFrame:
    """Chunks that hold q as it stands, or one of whose ids (its own, its conversation's, its first or last message's) or
    senders it is; the latest first. scope: see search_scope."""
    ids = [c for c in ("chunk_id", "conv_id", "first_uid", "last_uid") if c in chunks.columns]
    hit = F.lower("text").contains(q.lower()) | F.array_contains("sender_ids", q)
    hit = reduce(lambda a, b: a | b, [F.col(c) == q for c in ids], hit)
    found = search_scope(chunks, **scope).filter(F.coalesce(hit, F.lit(False)))
    return found.orderBy(F.desc("end_time"), "conv_id", F.desc("last_sequence"), "chunk_id").limit(candidates_of(limit))


def keyword_search(chunks: DataFrame, index: TextIndex, q: str, limit: int = 20, **scope) -> DataFrame:
    """chunk_id, score, rank: exact hits score 2, term hits 1, however good their BM25, which only chooses the candidates
    (ties: by conversation, from the last message back, then chunk_id).

    Terms are the query's n-grams and identifiers; one of several tokens, such as `plan_a`, is a phrase. A blank query, or one of more
    than 500 UTF-16 units, finds nothing; limit is 1 to 100. scope (see search_scope) holds for both, before any candidates are cut.
    """
    spark, q, limit = chunks.sparkSession, q.strip(), max(1, min(limit, 100))
    phrases = query_phrases(spark, q) if 0 < len(q.encode("utf-16-le")) <= 1000 else []
    exact = exact_search(chunks, q, limit, **scope) if 0 < len(q.encode("utf-16-le")) <= 1000 else chunks.limit(0)
    both = exact.select("chunk_id", F.lit(2.0).alias("score"))
    if phrases:
        inside = search_scope(chunks, **scope).select("chunk_id", "conv_id", "last_sequence")
        scored = bm25(index, phrases, within=inside if scope else None).join(inside, "chunk_id")
        best = scored.orderBy(F.desc("score"), "conv_id", F.desc("last_sequence"), "chunk_id").limit(candidates_of(limit))
        both = both.unionByName(best.select("chunk_id", F.lit(1.0).alias("score"))).groupBy("chunk_id").agg(F.max("score").alias("score"))
    ranked = Window.orderBy(F.desc("score"), "chunk_id")  # limit rows
    return both.orderBy(F.desc("score"), "chunk_id").limit(limit).withColumn("rank", F.row_number().over(ranked))


def validate_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """chunk_id, problem: wrong length, non-finite parts, or nothing but zeros."""
    v = F.col("vector")
    bad = (
        F.when(v.isNull() | (F.size(v) != dims), "dimension").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(~F.exists(v, lambda x: x != 0), "zero")
    )
    return vectors.select("chunk_id", bad.alias("problem")).filter("problem IS NOT NULL")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_search(vectors: DataFrame, query: Sequence[float], limit: int, scope: Column | None = None, prefilter: bool = False) -> DataFrame:
    """chunk_id, score, rank by cosine. The scope applies to the nearest neighbours found, so it can leave fewer than asked for; prefilter applies it first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(scope) if prefilter and scope is not None else vectors
    near = rows.withColumn("d", 1 - cosine(F.col("vector"), q)).orderBy("d", "chunk_id").limit(neighbours_of(limit))
    if scope is not None and not prefilter:
        near = near.filter(scope)
    return near.orderBy("d", "chunk_id").limit(limit).select("chunk_id", (1 - F.col("d")).alias("score"), F.row_number().over(Window.orderBy("d", "chunk_id")).alias("rank"))


def ranked(df: DataFrame, bucket: Column, *order) -> DataFrame:
    """df with rank, from 1, by (bucket, order): rows are ranked within their bucket, and only bucket sizes are summed across buckets."""
    d = df.withColumn("__b", bucket)
    sizes = d.groupBy("__b").agg(F.count("*").alias("__c"))
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = sizes.select("__b", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__o"))
    at = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return d.withColumn("__n", at).join(offsets, "__b").withColumn("rank", F.col("__n") + F.col("__o")).drop("__b", "__n", "__o")


def rrf(lists: list[DataFrame], limit: int, k: int = 60, chunks: DataFrame | None = None) -> DataFrame:
    """chunk_id, score, best: the sum of 1 / (k + rank) over ranked lists; ties go to the better best rank, then by
    conversation and from the last message back, where chunks tell them, then by chunk_id."""
    both = reduce(DataFrame.unionByName, [x.select("chunk_id", "rank") for x in lists])
    fused = both.groupBy("chunk_id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min("rank").alias("best"))
    ties = []
    if chunks is not None:
        fused = fused.join(chunks.select("chunk_id", "conv_id", "last_sequence"), "chunk_id", "left")
        ties = [F.asc_nulls_last("conv_id"), F.desc_nulls_last("last_sequence")]
    return fused.orderBy(F.desc("score"), "best", *ties, "chunk_id").limit(limit).select("chunk_id", "score", "best")


def hybrid_search(
    chunks: DataFrame, index: TextIndex, q: str, limit: int, vectors: DataFrame | None = None,
    query: Sequence[float] | None = None, dims: int | None = None, **scope,
) -> tuple[DataFrame, str | None]:
    """Hits and, where only keywords could be searched, why: not_configured, vector_unavailable or embedding_mismatch.

    scope (see search_scope) holds for the keywords and for the nearest vectors.
    """
    words = keyword_search(chunks, index, q, limit, **scope)
    wrong = dims is not None and query is not None and len(query) != dims
    why = "not_configured" if vectors is None else "vector_unavailable" if query is None else "embedding_mismatch" if wrong else None
    if why:
        return rrf([words], limit, chunks=chunks), why
    if scope:
        vectors = vectors.join(search_scope(chunks, **scope).select("chunk_id"), "chunk_id", "left_semi")
    return rrf([words, vector_search(vectors, query, limit)], limit, chunks=chunks), None


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(F.broadcast(hits), "chunk_id")  # hits are limited


def live_search(
    messages: DataFrame, q: str, limit: int, conv: str | None = None, sender: str | None = None,
    after: int | None = None, before: int | None = None,
) -> DataFrame:
    """Search on messages themselves, while there is no valid index; within a conversation, of a sender, in a span of time."""
    at, wanted = F.col("occurred_at_epoch_s"), F.lower("text").contains(q.lower())
    for value, test in ((conv, F.col("conv_id") == conv), (sender, F.col("sender") == sender), (after, at >= after), (before, at <= before)):
        wanted = wanted if value is None else wanted & test
    return messages.filter(wanted).orderBy(F.desc("occurred_at_epoch_s"), "conv_id", F.desc("canonical_seq")).limit(limit)


def index_status(chunks: DataFrame, vectors: DataFrame, meta: DataFrame, fingerprint: str) -> DataFrame:
    """One row, status (missing, ready, stale, invalid) and mode (hybrid, keyword)."""
    c, v = chunks.agg(F.count("*").alias("chunks")), vectors.agg(F.count("*").alias("vectors"))
    m = meta.agg(F.max("fingerprint").alias("fp"))
    status = F.when(F.col("fp").isNull(), "missing").when((F.col("vectors") > 0) & (F.col("vectors") != F.col("chunks")), "invalid").when(F.col("fp") != fingerprint, "stale").otherwise("ready")
    return c.crossJoin(v).crossJoin(m).select(status.alias("status"), F.when(F.col("vectors") > 0, "hybrid").otherwise("keyword").alias("mode"))  # one row each


def public_hits(hits: DataFrame, most: int = 4000) -> DataFrame:
    return hits.select("chunk_id", F.substring("text", 1, most).alias("text"), scalars.citation("message", F.col("chunk_id")).alias("citation"))
