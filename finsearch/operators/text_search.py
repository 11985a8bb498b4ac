"""Keyword search over a text index: conjunctive match, two scores, top-k with payload."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsearch.functions.stemming import stem_words
from finsearch.functions.text import is_indexed, words
from finsearch.functions.vectors import rounded
from finsearch.operators.ranking import small_side, top_k, with_payload
from finsearch.operators.text_index import TextIndex
from finsearch.session import written

SCORE_DIGITS = 9
LITERAL_TERMS = 200


def query_terms(index: TextIndex, queries: DataFrame) -> DataFrame:
    """``queries(query_id, text)`` to distinct terms, normalized like the documents."""
    kept = F.array_distinct(F.filter(words(F.col("text")), lambda w: is_indexed(w, index.stopwords)))
    terms = queries.select("query_id", kept.alias("terms"))
    if index.stem:
        stems = terms.select("query_id", F.explode("terms").alias("term")).withColumn("term", stem_words(F.col("term")))
        terms = stems.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    return terms.select("query_id", F.size("terms").cast("long").alias("n_terms"), F.explode("terms").alias("term"))


@dataclass(frozen=True)
class AskedTerms:
    """Terms of some queries with ``n_terms``, ``bucket``, ``df`` and ``idf``, and how many rows there are at most.

    ``literals`` holds the distinct (bucket, term) pairs while they are few, ``None`` otherwise.
    """

    weighted: DataFrame
    bound: int
    literals: list[tuple[int, str]] | None

    def narrow(self, table: DataFrame) -> DataFrame:
        """Only the folders and row groups that can hold the asked terms, when these fit in a filter."""
        return table if self.literals is None else _narrow(table, self.literals)


def _narrow(table: DataFrame, literals: list[tuple[int, str]]) -> DataFrame:
    rows = table.where(F.col("term").isin([term for _, term in literals]))
    if "bucket" in table.columns:
        rows = rows.where(F.col("bucket").isin(sorted({bucket for bucket, _ in literals})))
    return rows


def asked_terms(index: TextIndex, queries: DataFrame) -> AskedTerms:
    """Weigh the query terms that occur in the corpus."""
    terms = query_terms(index, queries).withColumn("bucket", index.bucket(F.col("term")))
    head = terms.select("bucket", "term").limit(LITERAL_TERMS + 1).collect()
    few = len(head) <= LITERAL_TERMS
    literals = sorted({(row[0], row[1]) for row in head}) if few else None
    bound = len(head) if few else terms.count()
    vocabulary = index.vocabulary.select("term", "df")
    vocabulary = _narrow(vocabulary, literals) if few else vocabulary
    n_docs = index.stats.select("n_docs").scalar()
    weighted = vocabulary.join(small_side(terms, bound), "term").withColumn(
        "idf", F.log(F.lit(1.0) + (n_docs - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    )
    return AskedTerms(weighted, bound, literals)


def term_hits(index: TextIndex, asked: AskedTerms, found: DataFrame, max_found: int) -> DataFrame:
    """One row per term of a query and document of ``found(query_id, id, ...)`` that holds it.

    Postings are cut to the found documents before they meet the queries, and both sides are broadcast when
    their counted sizes allow, so postings are matched where they lie; joining on the bucket prunes the other folders.
    """
    postings = asked.narrow(index.postings.select("bucket", "term", "id", "tf", "first_pos", "doc_len"))
    return postings.join(small_side(found, max_found), "id").join(small_side(asked.weighted, asked.bound), ["bucket", "term", "query_id"])


def _candidates(index: TextIndex, asked: AskedTerms) -> DataFrame:
    """``(id, asking)``: documents, and the queries for which they hold one of the rarest terms.

    What holds n of c terms holds one of any c - n + 1 of them: the rarest alone, unless queries share an id.
    Found where the postings lie, like all that follows: a shard has all terms of its documents.
    """
    own = Window.partitionBy("query_id", "n_terms")
    few = F.count("*").over(own) - F.col("n_terms") + 1
    rarest = asked.weighted.withColumns({"few": few, "place": F.row_number().over(own.orderBy("df", "term"))}).where("place <= few")
    postings = asked.narrow(index.postings.select("bucket", "term", "id")).where(F.col("id").isNotNull())
    held = postings.join(small_side(rarest.select("bucket", "term", "query_id"), asked.bound), ["bucket", "term"])
    return held.groupBy("id").agg(F.collect_set(F.struct("query_id")).alias("asking"))


def _met(index: TextIndex, asked: AskedTerms, columns: Sequence[str], terms: DataFrame, max_terms: int) -> list[DataFrame]:
    """Postings with ``columns`` and the ``terms(bucket, term, query_id, ...)`` they hold, of documents that may hold all terms of the query.

    Without the candidates every document would meet every query that has a frequent term. Documents without an id
    are one document, which is looked at for itself.
    """
    names = small_side(terms.select("bucket", "term").distinct(), max_terms)
    postings = asked.narrow(index.postings.select("bucket", "term", "id", *columns)).join(names, ["bucket", "term"], "left_semi")
    some = postings.join(_candidates(index, asked).hint("shuffle_hash"), "id").withColumn("asker", F.explode("asking")).drop("asking")
    some = some.join(small_side(terms.withColumn("asker", F.struct("query_id")), max_terms), ["bucket", "term", "asker"]).drop("asker")
    return [some, postings.where(F.col("id").isNull()).join(small_side(terms, max_terms), ["bucket", "term"])]


def _conjunctive(met: list[DataFrame], whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole`` of either part; their documents differ."""
    return reduce(DataFrame.unionByName, map(whole, met))


def matches(index: TextIndex, queries: DataFrame, scorer: str = "bm25", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents that hold *all* terms of a query, with a score. Queries without terms match nothing."""
    if scorer == "bm25":
        avg_len = index.stats.select("avg_len").scalar()
        norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") / avg_len)
        score = F.sum(F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm))
    elif scorer == "distance":
        gap = (F.max("first_pos") - F.min("first_pos")) / F.greatest(F.col("n_terms") - 1, F.lit(1))
        score = F.lit(1.0) / (F.lit(1.0) + gap)
    else:
        raise ValueError(f"unknown scorer {scorer!r}")
    asked = asked_terms(index, queries)

    def whole(hits: DataFrame) -> DataFrame:
        found = hits.groupBy("query_id", "id", "n_terms").agg(F.count("*").alias("n_matched"), rounded(score, SCORE_DIGITS).alias("score"))
        return found.where(F.col("n_matched") == F.col("n_terms")).select("query_id", "id", "score")

    return _conjunctive(_met(index, asked, ["tf", "first_pos", "doc_len"], asked.weighted, asked.bound), whole)


def _positions(index: TextIndex, queries: DataFrame, terms: DataFrame) -> list[DataFrame]:
    """Postings of the ``terms(query_id, term, ...)`` of queries with the places of their words, where they are stored."""
    if "positions" not in index.postings.columns:
        raise ValueError("the index has no positions: build it with positions=True")
    terms = terms.withColumn("bucket", index.bucket(F.col("term")))
    return _met(index, asked_terms(index, queries), ["positions"], terms, terms.count())


def phrase_matches(index: TextIndex, queries: DataFrame) -> DataFrame:
    """Documents that hold the words of a query in its order and at its distances: ``(query_id, id, occurrences, first_at)``.

    Stop words and empty words are skipped on both sides but keep their places. Every word of the query moves its
    positions back by its own place; what all words have in common are the starts of the phrase. Postings of a document
    lie in one shard, so words meet without a shuffle, and only documents with all of them are intersected.
    """
    placed = queries.select("query_id", F.posexplode(words(F.col("text"))).alias("offset", "term")).where(is_indexed(F.col("term"), index.stopwords))
    if index.stem:
        placed = placed.withColumn("term", stem_words(F.col("term")))
    placed = written(placed, "phrase")
    sizes = placed.groupBy("query_id").agg(F.count("*").alias("n_words"))
    placed = placed.join(small_side(sizes, sizes.count()), "query_id")
    starts = F.transform("positions", lambda p: p - F.col("offset"))

    def whole(hits: DataFrame) -> DataFrame:
        held = hits.groupBy("query_id", "id", "n_words").agg(F.collect_list(starts).alias("starts"))
        return held.where(F.size("starts") == F.col("n_words"))

    held = _conjunctive(_positions(index, queries, placed), whole)
    common = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), lambda found, more: F.array_intersect(found, more))
    found = held.select("query_id", "id", common.alias("at")).where(F.size("at") > 0)
    return found.select("query_id", "id", F.size("at").cast("long").alias("occurrences"), F.array_min("at").cast("long").alias("first_at"))


def window_matches(index: TextIndex, queries: DataFrame) -> DataFrame:
    """The smallest run of words that holds all terms of a query, for documents that hold them all: ``(query_id, id, window, score)``.

    The positions of all terms are swept once, in order; after each the window from the earliest last sight of a term
    is looked at. The score is 1 for adjacent terms and falls with the mean number of words between them.
    """
    terms = written(query_terms(index, queries), "terms")

    def whole(hits: DataFrame) -> DataFrame:
        held = hits.groupBy("query_id", "id", "n_terms").agg(F.collect_list("positions").alias("places"))
        return held.where(F.size("places") == F.col("n_terms"))

    held = _conjunctive(_positions(index, queries, terms), whole)
    sights = F.transform("places", lambda own, i: F.transform(own, lambda p: F.struct(p.cast("long").alias("at"), i.alias("term"))))
    never, none = F.lit(-1).cast("long"), F.lit(1 << 62).cast("long")

    def step(state: Column, sight: Column) -> Column:
        last = F.transform(state["last"], lambda p, i: F.when(i == sight["term"], sight["at"]).otherwise(p))
        start = F.array_min(last)
        return F.struct(last.alias("last"), F.when(start >= 0, F.least(state["best"], sight["at"] - start)).otherwise(state["best"]).alias("best"))

    first = F.struct(F.array_repeat(never, F.col("n_terms").cast("int")).alias("last"), none.alias("best"))
    best = F.aggregate(F.sort_array(F.flatten(sights)), first, step)["best"]
    found = held.select("query_id", "id", "n_terms", (best + 1).alias("window"))
    gap = (F.col("window") - F.col("n_terms")) / F.greatest(F.col("n_terms") - 1, F.lit(1))
    return found.select("query_id", "id", "window", rounded(F.lit(1.0) / (F.lit(1.0) + gap), SCORE_DIGITS).alias("score"))


def text_pool(index: TextIndex, queries: DataFrame, pool: int, scorer: str = "bm25") -> DataFrame:
    """The best documents per query, by score and then id, with ``rn``."""
    return top_k(matches(index, queries, scorer), ["query_id"], [F.desc("score"), F.asc("id")], pool)


def fulltext_search(
    index: TextIndex,
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scorer: str = "bm25",
    columns: Sequence[str] = ("ticker", "accession_number", "chunk_index", "chunk_text"),
) -> DataFrame:
    """Best k documents per query with their payload columns."""
    queries = written(queries, "queries")
    hits = text_pool(index, queries, k, scorer)
    return with_payload(hits, corpus, columns, k * queries.count())


def match_evidence(index: TextIndex, queries: DataFrame, pool: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Why a document was found: its query terms, their weights and their share of the score."""
    queries = written(queries, "queries")
    n_found = pool * queries.count()
    found = text_pool(index, queries, pool).select("query_id", "id", "score", "rn")
    avg_len = index.stats.select("avg_len").scalar()
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") / avg_len)
    part = F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)
    hits = term_hits(index, asked_terms(index, queries), found, n_found)
    return hits.select("query_id", "id", "rn", "term", "tf", "idf", (part / F.col("score")).alias("share"))
