"""One entry to all search modes, and the explanation of its results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.functions.text import route_query
from finsearch.functions.vectors import rounded
from finsearch.operators.hybrid import PAYLOAD, decorate, hybrid_search
from finsearch.operators.ranking import small_side, with_payload
from finsearch.operators.summarize import summarize
from finsearch.operators.text_index import TextIndex
from finsearch.operators.text_search import fulltext_search, match_evidence
from finsearch.operators.vector_search import BandIndex, CellIndex, ivf_search, lsh_search, vector_search
from finsearch.plans import lakehouse
from finsearch.session import written


@dataclass(frozen=True)
class SearchTables:
    """What a search reads: text index, vectors ``(id, embedding)``, payload and optional vector indexes."""

    index: TextIndex
    corpus: DataFrame
    payload: DataFrame
    cells: CellIndex | None = None
    bands: BandIndex | None = None


def nearest(
    tables: SearchTables, queries: DataFrame, pool: int, cutoff: float | None, vector_index: str = "exact", nprobe: int = 8
) -> DataFrame:
    """Vector pool by the chosen way: ``exact``, ``cells`` or ``bands``."""
    if vector_index == "exact":
        return vector_search(tables.corpus, queries, pool, cutoff)
    if vector_index == "cells" and tables.cells is not None:
        return ivf_search(tables.corpus.sparkSession, tables.cells, queries, nprobe, pool, cutoff)
    if vector_index == "bands" and tables.bands is not None:
        return lsh_search(tables.corpus.sparkSession, tables.bands, queries, pool, cutoff)
    raise ValueError(f"no vector index {vector_index!r}")


def search(
    tables: SearchTables,
    queries: DataFrame,
    mode: str = "hybrid",
    vector_index: str = "exact",
    scorer: str = "distance",
    reranker: str | Callable[[str, list[str]], Sequence[float]] | None = None,
    cutoff: float | None = 0.5,
    nprobe: int = 8,
    k: int = 10,
) -> DataFrame:
    """Decorated results of ``queries(query_id, text, vector)``.

    ``mode`` is ``fulltext``, ``vector`` or ``hybrid``. A hybrid search adds the scores unless
    ``reranker`` is ``"rrf"`` (reciprocal ranks), ``"rerank"`` (ranks, then term coverage) or a function.
    """
    none = F.lit(None).cast("string")
    queries = written(queries, "queries")
    if mode == "fulltext":
        found = fulltext_search(tables.index, tables.payload, queries, k, scorer).withColumn("retrieval_method", none)
    elif mode == "vector":
        near = nearest(tables, queries, 50, cutoff, vector_index, nprobe).where(F.col("rn") <= k)
        found = with_payload(near, tables.payload, PAYLOAD, k * queries.count()).select(
            "*", rounded(F.lit(1.0) - F.col("distance"), 9).alias("score"), none.alias("retrieval_method")
        )
    elif mode == "hybrid":
        fusion = {None: "sum", "rrf": "rrf"}.get(reranker, "rerank")
        pool = 100 if fusion == "rerank" else 20
        found = hybrid_search(
            tables.index,
            tables.corpus,
            queries,
            fusion,
            k,
            scorer=scorer,
            reranker=reranker if callable(reranker) else None,
            vector_hits=nearest(tables, queries, pool, cutoff, vector_index, nprobe),
            payload=tables.payload,
        )
        if fusion == "rerank":
            found = found.withColumn("score", F.col("rerank_score"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return decorate(found)


def analyze_hits(
    index: TextIndex, payload: DataFrame, queries: DataFrame, k: int = 10, n_sentences: int = 3
) -> DataFrame:
    """Summary of each of the k best texts per query, and the terms that explain the match, weightiest first."""
    queries = written(queries, "queries")
    evidence = match_evidence(index, queries, k)
    terms = F.array_sort(F.collect_list(F.struct((-rounded(F.col("share"), 6)).alias("order"), "term")))
    why = evidence.groupBy("query_id", "id", "rn").agg(
        F.concat_ws(", ", F.transform(terms, lambda t: t["term"])).alias("explanation")
    )
    why = written(why, "evidence")
    bound = k * queries.count()
    found = payload.select("id", F.col("chunk_text").alias("text")).join(
        small_side(why.select("id").distinct(), bound), "id", "left_semi"
    )
    n_docs = index.stats.select("n_docs").scalar()
    idf = index.vocabulary.select("term", F.log(n_docs / F.col("df")).alias("idf"))
    return why.join(summarize(found, "text", n_sentences, index.stopwords, idf), "id")


def lakehouse_search(
    queries: DataFrame,
    corpus: DataFrame,
    payload: DataFrame,
    view: DataFrame,
    concepts: DataFrame,
    tickers: DataFrame,
    tag: str = "Revenues",
    fp: str = "FY",
) -> tuple[DataFrame, DataFrame]:
    """Route each query by its text: symbols get their newest filings, questions their nearest chunks
    with revenues. Returns (filings, financials)."""
    routed = queries.withColumn("route", route_query(F.col("text")))
    symbols = routed.where(F.col("route") == "ticker").select(F.col("text").alias("Symbol"))
    questions = routed.where(F.col("route") == "semantic").drop("route")
    return (
        lakehouse.security_lookup(view, symbols),
        lakehouse.semantic_financials(corpus, questions, concepts, tickers, tag, fp, payload=payload),
    )
