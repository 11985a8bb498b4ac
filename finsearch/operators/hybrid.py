"""Hybrid search: one keyword pool and one vector pool per query, fused and optionally reranked."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsearch.functions.text import document_type
from finsearch.functions.vectors import rounded
from finsearch.operators.ranking import small_side, top_k, with_payload
from finsearch.operators.text_index import TextIndex
from finsearch.operators.text_search import SCORE_DIGITS, asked_terms, term_hits, text_pool
from finsearch.operators.vector_search import vector_search
from finsearch.session import written

PAYLOAD = ("ticker", "accession_number", "chunk_index", "chunk_text")


def ranked(pool: DataFrame, order: Column) -> DataFrame:
    """Shared ranks inside each query's pool. The pool is already cut, so the window stays small."""
    return pool.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(order)).cast("long"))


def retrieval_label(in_vector: Column, in_text: Column) -> Column:
    """``VECTOR``, ``FTS`` or ``VECTOR+FTS``."""
    return F.concat_ws("+", F.when(in_vector, F.lit("VECTOR")), F.when(in_text, F.lit("FTS")))


def fuse(text: DataFrame, vector: DataFrame, fusion: str = "rrf", k0: int = 60) -> DataFrame:
    """Full outer join of two pools with a fused score; a missing side counts as zero."""
    if fusion == "rrf":
        text = ranked(text, F.desc("score")).select("query_id", "id", F.col("rank").alias("t"))
        vector = ranked(vector, F.asc("distance")).select("query_id", "id", F.col("rank").alias("v"))
        one = F.lit(1.0)
        score = F.coalesce(one / (k0 + F.col("v")), F.lit(0.0)) + F.coalesce(one / (k0 + F.col("t")), F.lit(0.0))
    elif fusion == "sum":
        text = text.select("query_id", "id", F.col("score").alias("t"))
        vector = vector.select("query_id", "id", F.col("distance").alias("v"))
        score = F.coalesce(F.col("t"), F.lit(0.0)) + F.coalesce(F.lit(1.0) - F.col("v"), F.lit(0.0))
    else:
        raise ValueError(f"unknown fusion {fusion!r}")
    return text.join(vector, ["query_id", "id"], "full").select(
        "query_id",
        "id",
        rounded(score, SCORE_DIGITS).alias("score"),
        retrieval_label(F.col("v").isNotNull(), F.col("t").isNotNull()).alias("retrieval_method"),
    )


def hybrid_candidates(
    index: TextIndex,
    corpus: DataFrame,
    queries: DataFrame,
    pool: int = 20,
    k: int = 10,
    fusion: str = "rrf",
    cutoff: float | None = 0.5,
    scorer: str = "bm25",
    k0: int = 60,
    vector_hits: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, id, score, retrieval_method, rank_id)``: best k of the fused pools.

    ``vector_hits`` takes the place of the exact scan, for instance from a cell index.
    """
    vector = vector_search(corpus, queries, pool, cutoff) if vector_hits is None else vector_hits
    fused = fuse(text_pool(index, queries, pool, scorer), vector, fusion, k0)
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc("id")], k, "rank_id")


def coverage_scores(index: TextIndex, queries: DataFrame, candidates: DataFrame, n_candidates: int) -> DataFrame:
    """Default reranker: idf-weighted share of the query's terms found in the candidate, then BM25."""
    asked = asked_terms(index, queries)
    total = asked.weighted.groupBy("query_id").agg(F.sum("idf").alias("query_weight"))
    avg_len = index.stats.select("avg_len").scalar()
    norm = F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * F.col("doc_len") / avg_len)
    found = (
        term_hits(index, asked, candidates.select("query_id", "id"), n_candidates)
        .groupBy("query_id", "id")
        .agg(
            F.sum("idf").alias("weight"),
            F.sum(F.col("idf") * F.col("tf") * F.lit(2.2) / (F.col("tf") + norm)).alias("bm25"),
        )
    )
    return (
        candidates.join(found, ["query_id", "id"], "left")
        .join(small_side(total, asked.bound), "query_id", "left")
        .withColumn("rerank_score", rounded(F.coalesce(F.col("weight") / F.col("query_weight"), F.lit(0.0)), SCORE_DIGITS))
        .withColumn("bm25", rounded(F.coalesce("bm25", F.lit(0.0)), SCORE_DIGITS))
        .drop("weight", "query_weight")
    )


def user_scores(candidates: DataFrame, queries: DataFrame, scorer: Callable[[str, list[str]], Sequence[float]]) -> DataFrame:
    """Rerank with ``scorer(query_text, texts) -> scores``, one call per query on its bounded pool."""
    key = candidates.schema["query_id"].dataType.simpleString()

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank_id")
        values = scorer(pdf["text"].iloc[0], pdf["chunk_text"].tolist())
        return pd.DataFrame({"query_id": pdf["query_id"], "rank_id": pdf["rank_id"], "rerank_score": list(values)})

    scored = (
        candidates.select("query_id", "rank_id", "chunk_text")
        .join(queries.select("query_id", "text"), "query_id")
        .groupBy("query_id")
        .applyInPandas(score, f"query_id {key}, rank_id long, rerank_score double")
    )
    return candidates.join(scored, ["query_id", "rank_id"]).withColumn("bm25", F.lit(0.0))


def hybrid_search(
    index: TextIndex,
    corpus: DataFrame,
    queries: DataFrame,
    fusion: str = "rrf",
    k: int = 10,
    pool: int | None = None,
    cutoff: float | None = 0.5,
    scorer: str = "bm25",
    reranker: Callable[[str, list[str]], Sequence[float]] | None = None,
    columns: Sequence[str] = PAYLOAD,
    vector_hits: DataFrame | None = None,
    payload: DataFrame | None = None,
) -> DataFrame:
    """Hybrid search over ``queries(query_id, text, vector)``.

    ``fusion`` is ``"sum"``, ``"rrf"`` or ``"rerank"``: the last fuses pools of 100, numbers the best
    100 and lets a reranker pick the final k, by default with ``coverage_scores``. ``corpus`` holds the
    vectors; texts and other columns come from ``payload`` where they are stored apart.
    """
    payload = corpus if payload is None else payload
    queries = written(queries, "queries")
    n_queries = queries.count()
    if fusion != "rerank":
        top = hybrid_candidates(index, corpus, queries, pool or 20, k, fusion, cutoff, scorer, vector_hits=vector_hits)
        return with_payload(top, payload, columns, k * n_queries)
    pool = pool or 100
    # used twice below: written once, instead of searching twice
    top = written(hybrid_candidates(index, corpus, queries, pool, pool, "rrf", cutoff, scorer, vector_hits=vector_hits), "candidates")
    if reranker is None:
        scored = coverage_scores(index, queries, top, pool * n_queries)
    else:
        scored = user_scores(with_payload(top, payload, ["chunk_text"], pool * n_queries), queries, reranker).drop("chunk_text")
    best = top_k(scored, ["query_id"], [F.desc("rerank_score"), F.desc("bm25"), F.asc("rank_id")], k, "rn")
    return with_payload(best, payload, columns, k * n_queries)


def candidate_arrays(candidates: DataFrame, corpus: DataFrame, n_candidates: int) -> DataFrame:
    """One ordered array of texts per query, as a reranking model takes them."""
    texts = with_payload(candidates.select("query_id", "id", "rank_id"), corpus, ["chunk_text"], n_candidates)
    pairs = F.array_sort(F.collect_list(F.struct("rank_id", "chunk_text")))
    return texts.groupBy("query_id").agg(F.transform(pairs, lambda p: p["chunk_text"]).alias("documents"))


def decorate(results: DataFrame) -> DataFrame:
    """Presentation columns of a search result."""
    fallback = F.concat_ws("-", "ticker", F.col("chunk_index").cast("string"))
    return results.select(
        "query_id",
        F.coalesce(F.col("id").cast("string"), fallback).alias("id"),
        "ticker",
        document_type(F.col("accession_number")).alias("type"),
        F.col("chunk_text").alias("text"),
        rounded(F.coalesce("score", F.lit(0.0)), 4).alias("score"),
        "accession_number",
        "chunk_index",
        "retrieval_method",
    )
