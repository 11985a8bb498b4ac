"""Keyword, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.functions.text import TOKEN_GAP
from finsearch.functions.vectors import cosine_distance, rounded
from finsearch.operators import hybrid, text_search, vector_search
from finsearch.operators.hybrid import ranked
from finsearch.operators.embedding import Embedder, embed, fit_embedder, load_embedder
from finsearch.operators.segments import SegmentedIndex
from finsearch.operators.summarize import summarize
from finsearch.operators.text_index import build_text_index, save_text_index
from finsearch.plans.search import SearchTables, search
from finsearch.plans.search import analyze_hits as explain_hits
from finsearch.registry import query
from finsearch.registry.roles import CUTOFF, SQL, Roles, with_roles
from finsearch.session import work_dir, written

TEXT_POOL = """SELECT query_id, id, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS rn
    FROM matched QUALIFY rn <= {k}"""
VECTOR_POOL = """SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn
    FROM far WHERE distance < {cutoff} QUALIFY rn <= {k}"""
RRF = """SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.id, v.id) AS id,
    round(coalesce(1.0::DOUBLE / (60 + v.r), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + t.r), 0.0::DOUBLE), 9) + 0.0 AS score,
    concat_ws('+', CASE WHEN v.id IS NOT NULL THEN 'VECTOR' END, CASE WHEN t.id IS NOT NULL THEN 'FTS' END) AS retrieval_method
    FROM (SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM text_pool) t
    FULL OUTER JOIN (SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY distance) AS r FROM vector_pool) v
    ON t.query_id = v.query_id AND t.id = v.id"""
SUM = """SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.id, v.id) AS id,
    round(coalesce(t.score, 0.0::DOUBLE) + coalesce(1.0::DOUBLE - v.distance, 0.0::DOUBLE), 9) + 0.0 AS score,
    concat_ws('+', CASE WHEN v.id IS NOT NULL THEN 'VECTOR' END, CASE WHEN t.id IS NOT NULL THEN 'FTS' END) AS retrieval_method
    FROM text_pool t FULL OUTER JOIN vector_pool v ON t.query_id = v.query_id AND t.id = v.id"""
NUMBERED = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank_id FROM fused QUALIFY rank_id <= {k}"""
PAYLOAD = "ticker, accession_number, chunk_index, chunk_text"


def fused_sql(fusion: str, pool: int, k: int, body: str, more: dict | None = None, replace: dict | None = None) -> str:
    steps = {
        "text_pool": TEXT_POOL.format(score="score", k=pool),
        "vector_pool": VECTOR_POOL.format(cutoff=CUTOFF, k=pool),
        "fused": fusion,
        "numbered": NUMBERED.format(k=k),
        **(more or {}),
    }
    return with_roles("matched", "far", body=body, more=steps, replace=replace)


# --- index ---------------------------------------------------------------------------------------


@query(
    "text_index_stats",
    with_roles(
        "postings",
        "stats",
        body="""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, min(first_pos) AS earliest,
        max(n_docs) AS n_docs, round(max(avg_len), 6) AS avg_len FROM postings CROSS JOIN stats GROUP BY term""",
    ),
)
def text_index_stats(r: Roles) -> DataFrame:
    index = r.text_index()
    n_docs, avg_len = (index.stats.select(c).scalar() for c in ("n_docs", "avg_len"))
    return (
        index.postings.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.min("first_pos").cast("long").alias("earliest"))
        .withColumn("n_docs", n_docs)
        .withColumn("avg_len", F.round(avg_len, 6))
    )


@query("text_index_build", with_roles("postings", body="SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM postings GROUP BY term"))
def text_index_build(r: Roles) -> DataFrame:
    """Built and written anew, unlike the index that the searches share."""
    index = build_text_index(r.texts(), "id", "chunk_text", buckets=8)
    return save_text_index(index, work_dir(r.spark, "text-index")).vocabulary


@query(
    "text_index_positions",
    with_roles("tokens", body="SELECT term, id, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS places FROM tokens GROUP BY term, id"),
)
def text_index_positions(r: Roles) -> DataFrame:
    index = build_text_index(r.texts(), "id", "chunk_text", positions=True)
    return index.postings.select("term", "id", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("places"))


@query(
    "text_index_append",
    with_roles(
        "postings",
        "stats",
        replace={"chunks": SQL["chunks"] + " WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"},
        body="""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, max(n_docs) AS n_docs, round(max(avg_len), 6) AS avg_len
        FROM postings CROSS JOIN stats GROUP BY term""",
    ),
)
def text_index_append(r: Roles) -> DataFrame:
    """Half the documents, then the rest, then without the toxic ones: what an index of the others says, built at once."""
    index = SegmentedIndex.create(r.spark, work_dir(r.spark, "segments"), buckets=8)
    for half in (0, 1):
        index.append(r.texts().where(F.col("id") % 2 == half), "id", "chunk_text")
    index.delete(r.fraud_labels().where("is_fraud"), "transaction_id")
    found = index.open()
    n_docs, avg_len = (found.stats.select(c).scalar() for c in ("n_docs", "avg_len"))
    return found.vocabulary.withColumn("n_docs", n_docs).withColumn("avg_len", F.round(avg_len, 6))


@query("fts_stemmed")
def fts_stemmed(r: Roles) -> DataFrame:
    """Keyword search over stems; SQL has no stemmer, a test compares it with plain code."""
    index = build_text_index(r.texts(), "id", "chunk_text", stem=True, buckets=8)
    return text_search.matches(save_text_index(index, work_dir(r.spark, "stemmed-index")), r.queries())


# --- keyword -------------------------------------------------------------------------------------


@query("fts_match", with_roles("matched", body="SELECT query_id, id FROM matched"))
def fts_match(r: Roles) -> DataFrame:
    return text_search.matches(r.text_index(), r.queries()).select("query_id", "id")


@query("fts_bm25", with_roles("matched", body="SELECT query_id, id, score FROM matched"))
def fts_bm25(r: Roles) -> DataFrame:
    return text_search.matches(r.text_index(), r.queries())


@query("fts_proximity", with_roles("matched", body="SELECT query_id, id, near_score AS score FROM matched"))
def fts_proximity(r: Roles) -> DataFrame:
    return text_search.matches(r.text_index(), r.queries(), "distance")


@query(
    "fts_phrase",
    with_roles(
        "tokens",
        "queries",
        more={
            "phrase": f"""SELECT query_id, pos AS place, term FROM (SELECT query_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term
                FROM (SELECT query_id, regexp_split_to_array(lower(text), '{TOKEN_GAP}') AS w FROM queries)) WHERE term <> '' AND term NOT IN (SELECT term FROM stop)""",
            "begun": "SELECT query_id, id, pos - place AS begin_at, count(*) AS n FROM phrase JOIN tokens USING (term) GROUP BY ALL",
        },
        body="""SELECT query_id, id, count(*) AS occurrences, CAST(min(begin_at) AS BIGINT) AS first_at
        FROM begun JOIN (SELECT query_id, count(*) AS n FROM phrase GROUP BY query_id) USING (query_id, n) GROUP BY query_id, id""",
    ),
)
def fts_phrase(r: Roles) -> DataFrame:
    return text_search.phrase_matches(r.text_index(positions=True), r.queries())


@query(
    "fts_window",
    with_roles(
        "matched",
        "tokens",
        "query_terms",
        more={
            "seen": "SELECT query_id, id, term, pos FROM matched JOIN query_terms USING (query_id) JOIN tokens USING (id, term)",
            "sizes": "SELECT query_id, count(*) AS n_terms FROM query_terms GROUP BY query_id",
            "lasts": """SELECT a.query_id, a.id, a.pos, b.term, max(b.pos) AS last FROM (SELECT DISTINCT query_id, id, pos FROM seen) a
                JOIN seen b ON a.query_id = b.query_id AND a.id = b.id AND b.pos <= a.pos GROUP BY ALL""",
            "ends": "SELECT query_id, id, pos - min(last) + 1 AS size, count(*) AS n_terms FROM lasts GROUP BY query_id, id, pos",
            "best": "SELECT query_id, id, n_terms, CAST(min(size) AS BIGINT) AS size FROM ends JOIN sizes USING (query_id, n_terms) GROUP BY query_id, id, n_terms",
        },
        body='''SELECT query_id, id, size AS "window", round(1.0::DOUBLE / (1.0::DOUBLE + (size - n_terms) / greatest(n_terms - 1, 1)::DOUBLE), 9) + 0.0 AS score FROM best''',
    ),
)
def fts_window(r: Roles) -> DataFrame:
    return text_search.window_matches(r.text_index(positions=True), r.queries())


def _fulltext_sql(score: str) -> str:
    return with_roles(
        "matched",
        "chunks",
        more={"pool": TEXT_POOL.format(score=score, k=10)},
        body=f"""SELECT query_id, p.id, score, rn, {PAYLOAD} FROM pool p JOIN chunks c ON p.id = c.id""",
    )


@query("fulltext_search", _fulltext_sql("score"))
def fulltext_search(r: Roles) -> DataFrame:
    return text_search.fulltext_search(r.text_index(), r.texts(), r.queries())


@query("fulltext_search_proximity", _fulltext_sql("near_score"))
def fulltext_search_proximity(r: Roles) -> DataFrame:
    return text_search.fulltext_search(r.text_index(), r.texts(), r.queries(), scorer="distance")


@query(
    "rank_fts",
    with_roles(
        "matched",
        more={"pool": TEXT_POOL.format(score="score", k=20)},
        body="SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM pool",
    ),
)
def rank_fts(r: Roles) -> DataFrame:
    return ranked(text_search.text_pool(r.text_index(), r.queries(), 20), F.desc("score")).select("query_id", "id", "rank")


@query(
    "match_evidence",
    with_roles(
        "matched",
        "hits",
        more={"pool": TEXT_POOL.format(score="score", k=10)},
        body="""SELECT h.query_id, h.id, p.rn, h.term, h.tf, round(h.idf, 6) AS idf, round(h.part / p.score, 6) AS share
        FROM hits h JOIN pool p ON h.query_id = p.query_id AND h.id = p.id""",
    ),
)
def match_evidence(r: Roles) -> DataFrame:
    found = text_search.match_evidence(r.text_index(), r.queries())
    return found.withColumn("idf", F.round("idf", 6)).withColumn("share", F.round("share", 6))


# --- vector --------------------------------------------------------------------------------------


@query(
    "pair_distance",
    """SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) + 0.0 AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""",
)
def pair_distance(r: Roles) -> DataFrame:
    vectors = r.table("embeddings").select("vec_id", "embedding")
    n = r.n_vectors()
    other = vectors.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return (
        vectors.withColumn("other_id", (F.col("vec_id") + 1) % n)
        .join(other, "other_id")
        .select("vec_id", "other_id", rounded(cosine_distance(F.col("embedding"), F.col("other")), 9).alias("distance"))
    )


NEAREST = with_roles(
    "vector_far",
    body=f"""SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn
    FROM vector_far WHERE distance < {CUTOFF} QUALIFY rn <= 50""",
)


@query(
    "vector_search",
    with_roles(
        "chunks",
        "query_batch",
        more={
            "far_batch": """SELECT query_id, id, round(list_cosine_distance(embedding, vector), 9) + 0.0 AS distance
            FROM chunks CROSS JOIN query_batch WHERE embedding IS NOT NULL""",
            "pool": VECTOR_POOL.replace("FROM far", "FROM far_batch").format(cutoff=CUTOFF, k=10),
        },
        body=f"""SELECT query_id, p.id, rn, round(1.0::DOUBLE - distance, 9) + 0.0 AS score, {PAYLOAD}
        FROM pool p JOIN chunks c ON p.id = c.id""",
    ),
)
def vector_search_payload(r: Roles) -> DataFrame:
    queries, corpus = r.query_batch(), r.chunks()
    near = vector_search.vector_search(corpus, queries, 50, CUTOFF).where(F.col("rn") <= 10)
    found = hybrid.with_payload(near, r.texts(), hybrid.PAYLOAD, 10 * queries.count())
    return found.withColumn("score", rounded(F.lit(1.0) - F.col("distance"), 9)).drop("distance")


@query(
    "rank_vec",
    with_roles(
        "vector_far",
        more={"pool": VECTOR_POOL.replace("FROM far", "FROM vector_far").format(cutoff=CUTOFF, k=20)},
        body="SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY distance) AS rank FROM pool",
    ),
)
def rank_vec(r: Roles) -> DataFrame:
    pool = vector_search.vector_search(r.vectors(), r.query_batch(), 20, CUTOFF)
    return ranked(pool, F.asc("distance")).select("query_id", "id", "rank")


@query("ivf_search_full", NEAREST)
def ivf_search_full(r: Roles) -> DataFrame:
    nlist = 16
    index = vector_search.build_ivf(r.vectors(), nlist, work_dir(r.spark, "cells"))
    return vector_search.ivf_search(r.spark, index, r.query_batch(), nlist, 50, CUTOFF)


@query("ivf_join_full", NEAREST)
def ivf_join_full(r: Roles) -> DataFrame:
    """Queries with textual keys find the same rows."""
    nlist = 16
    index = vector_search.build_ivf(r.vectors(), nlist, work_dir(r.spark, "cells"))
    named = r.query_batch().withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    found = vector_search.ivf_search(r.spark, index, named, nlist, 50, CUTOFF)
    return found.withColumn("query_id", F.substring("query_id", 2, 20).cast("long"))


@query("ivf_search")
def ivf_search(r: Roles) -> DataFrame:
    """Part of the cells; the given vectors have no clusters, so many of them are needed."""
    index = vector_search.build_ivf(r.vectors(), 16, work_dir(r.spark, "cells"))
    return vector_search.ivf_search(r.spark, index, r.query_batch(), 12, 50, CUTOFF)


@query("vector_search_grid", NEAREST)
def vector_search_grid(r: Roles) -> DataFrame:
    """The exact scan in small packs of queries: the grid that large query tables take."""
    return vector_search.vector_search(r.vectors(), r.query_batch(), 50, CUTOFF, pack_rows=32)


def _codes_search(r: Roles) -> DataFrame:
    index = vector_search.build_codes(r.vectors(), 16, work_dir(r.spark, "codes"))
    return vector_search.codes_search(r.spark, index, r.query_batch(), 12, 50, CUTOFF)


@query("ivf_codes_search")
def ivf_codes_search(r: Roles) -> DataFrame:
    """Short lists by codes of 16 bytes in part of the cells, then exact distances; approximate, so without a SQL form."""
    return _codes_search(r)


@query(
    "ivf_codes_recall",
    with_roles(
        "vector_far",
        body=f"""SELECT query_id, count(*) AS n_nearest, true AS recalled FROM (SELECT query_id, id FROM vector_far WHERE distance < {CUTOFF}
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10) GROUP BY query_id""",
    ),
)
def ivf_codes_recall(r: Roles) -> DataFrame:
    """Per query, its ten exact neighbours, and whether all queries together find nine of ten of them by codes."""
    exact = vector_search.vector_search(r.vectors(), r.query_batch(), 10, CUTOFF).select("query_id", "id")
    found = _codes_search(r).where("rn <= 10").select("query_id", "id", F.lit(1).alias("hit"))
    counted = written(exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("n_nearest"), F.count("hit").alias("hits")), "recall")
    share = counted.agg((F.sum("hits") / F.sum("n_nearest")).alias("share")).scalar()
    return counted.select("query_id", "n_nearest", (share >= 0.9).alias("recalled"))


LSH = vector_search.BandIndex("", 64, 4, 7, 7, 48)  # bits of a larger table; probes for a reach of 0.8
PLANES = ", ".join("(" + f"{i}, [" + ", ".join(f"{x:.17g}::DOUBLE" for x in plane) + "])" for i, plane in enumerate(LSH.planes()))


@query(
    "lsh_search",
    with_roles(
        "vector_far",
        more={
            "planes": f"SELECT * FROM (VALUES {PLANES}) AS t(no, plane)",
            "sides": f"""SELECT vec_id AS id, no // {LSH.bits} AS band, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], plane) >= 0 THEN 1 << (no % {LSH.bits}) ELSE 0 END)::BIGINT AS signature
                FROM embeddings CROSS JOIN planes GROUP BY ALL""",
            "margins": f"SELECT query_id, no // {LSH.bits} AS band, no % {LSH.bits} AS bit, list_dot_product(vector, plane) AS m FROM query_batch CROSS JOIN planes",
            "own": "SELECT query_id, band, list(m * m ORDER BY bit) AS costs, sum(CASE WHEN m >= 0 THEN 1 << bit ELSE 0 END)::BIGINT AS signature FROM margins GROUP BY ALL",
            "probes": f"""SELECT query_id, band, xor(signature, flip) AS signature FROM (SELECT *, unnest(range({1 << LSH.bits})) AS flip FROM own)
                QUALIFY row_number() OVER (PARTITION BY query_id, band ORDER BY
                list_sum(list_transform(range({LSH.bits}), lambda i: CASE WHEN (flip >> i) & 1 = 1 THEN costs[i + 1] ELSE 0 END)), flip) <= {LSH.probes}""",
            "met": "SELECT DISTINCT query_id, id FROM probes JOIN sides USING (band, signature)",
        },
        body=f"""SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn
        FROM vector_far JOIN met USING (query_id, id) WHERE distance < {CUTOFF} QUALIFY rn <= 50""",
    ),
)
def lsh_search(r: Roles) -> DataFrame:
    index = vector_search.build_lsh(r.vectors(), work_dir(r.spark, "bands"), LSH.dim, LSH.bands, LSH.bits, LSH.seed, LSH.probes)
    return vector_search.lsh_search(r.spark, index, r.query_batch(), 50, CUTOFF)


# words hashed to slots, weighted and scaled as the stored model says
EMBEDDED = {
    "texts": "SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark",
    "slotted": r"""SELECT kind, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS slot, count(*) AS tf
        FROM (SELECT kind, id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS w FROM texts) WHERE w <> '' GROUP BY ALL""",
    "slot_idf": """SELECT slot, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) FILTER (kind = 'd') + 1)::DOUBLE) AS idf
        FROM (SELECT unnest(range(256)) AS slot) LEFT JOIN slotted USING (slot) GROUP BY slot""",
    "weights": "SELECT kind, id, slot, tf * idf AS w FROM slotted JOIN slot_idf USING (slot)",
    "unit": "SELECT kind, id, slot, CASE WHEN n > 0 THEN w / n ELSE 0 END AS w FROM weights JOIN (SELECT kind, id, sqrt(sum(w * w)) AS n FROM weights GROUP BY kind, id) USING (kind, id)",
}


def stored_embedder(r: Roles) -> Embedder:
    """The model of all documents, saved and opened again."""
    path = work_dir(r.spark, "embedder")
    fit_embedder(r.table("documents")).save(r.spark, path)
    return load_embedder(r.spark, path)


@query("embed_docs", with_roles(more=EMBEDDED, body="SELECT id AS doc_id, slot, round(w, 6) + 0.0 AS weight, 'tfidf-hash-256' AS embedding_model FROM unit WHERE kind = 'd' AND w > 0"))
def embed_docs(r: Roles) -> DataFrame:
    """The vectors of all documents, without their zeros."""
    found = embed(r.table("documents").select("doc_id", "text"), embedder=stored_embedder(r))
    cells = found.select("doc_id", "embedding_model", F.posexplode("embedding").alias("slot", "weight")).where("weight > 0")
    return cells.select("doc_id", F.col("slot").cast("long").alias("slot"), (F.round("weight", 6) + 0.0).alias("weight"), "embedding_model")


def _letters(texts: list[str]) -> list[list[float]]:
    """A model of the user: how many of the first letters of the alphabet a text has."""
    return [[float(t.count(c)) for c in "abcde"] for t in texts]


@query(
    "embed_with_model",
    "SELECT doc_id, " + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS {c}" for c in "abcde") + ", 'letters' AS embedding_model FROM documents",
)
def embed_with_model(r: Roles) -> DataFrame:
    found = embed(r.table("documents").select("doc_id", "text"), model="letters", encode=_letters)
    return found.select("doc_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("abcde")], "embedding_model")


@query(
    "text_vector_search",
    with_roles(
        more={
            **EMBEDDED,
            "near": """SELECT q.id AS query_id, d.id, 1 - sum(q.w * d.w) AS far FROM unit q JOIN unit d ON q.kind = 'q' AND d.kind = 'd' AND q.slot = d.slot
                GROUP BY q.id, d.id""",
            "rated": "SELECT query_id, id, round(far, 9) + 0.0 AS distance FROM near",
            "best": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM rated WHERE distance < {CUTOFF} QUALIFY rn <= 10",
        },
        body="SELECT query_id, id, rn, round(distance, 6) + 0.0 AS distance FROM best",
    ),
)
def text_vector_search(r: Roles) -> DataFrame:
    """Every benchmark text as a query over all documents, in the vector space of the documents."""
    model = stored_embedder(r)
    corpus = model.transform(r.table("documents").select(F.col("doc_id").alias("id"), "text")).drop("text")
    asked = model.transform(r.table("benchmark").select(F.col("item_id").alias("query_id"), "text"), name="vector").drop("text")
    found = vector_search.vector_search(corpus, asked, 10, CUTOFF)
    return found.withColumn("distance", rounded(F.col("distance"), 6))


# --- hybrid --------------------------------------------------------------------------------------


@query(
    "hybrid_sum",
    fused_sql(SUM, 20, 10, f"SELECT query_id, n.id, rank_id, score, retrieval_method, {PAYLOAD} FROM numbered n JOIN chunks c ON n.id = c.id"),
)
def hybrid_sum(r: Roles) -> DataFrame:
    return hybrid.hybrid_search(r.text_index(), r.chunks(), r.queries(), "sum", cutoff=CUTOFF, payload=r.texts())


RRF_RESULT = f"SELECT query_id, n.id, rank_id, score, retrieval_method, {PAYLOAD} FROM numbered n JOIN chunks c ON n.id = c.id"


@query("hybrid_rrf", fused_sql(RRF, 20, 10, RRF_RESULT))
def hybrid_rrf(r: Roles) -> DataFrame:
    return hybrid.hybrid_search(r.text_index(), r.chunks(), r.queries(), "rrf", cutoff=CUTOFF, payload=r.texts())


BATCH_ROLE = {"queries": "SELECT item_id AS query_id, text, embedding::DOUBLE[] AS vector FROM benchmark JOIN embeddings ON vec_id = item_id"}


@query(
    "hybrid_batch",
    fused_sql(RRF, 20, 10, "SELECT query_id, id, rank_id, score, retrieval_method FROM numbered", replace=BATCH_ROLE),
)
def hybrid_batch(r: Roles) -> DataFrame:
    return hybrid.hybrid_candidates(r.text_index(), r.chunks(), r.query_batch(), 20, 10, "rrf", CUTOFF)


@query(
    "search_decorated",
    fused_sql(
        RRF,
        20,
        10,
        """SELECT query_id, CAST(n.id AS VARCHAR) AS id, ticker,
        CASE WHEN lower(accession_number) LIKE '%13f%' THEN 'Form 13F' ELSE 'Form 10-K' END AS type, chunk_text AS text,
        round(score, 4) + 0.0 AS score, accession_number, chunk_index, retrieval_method
        FROM numbered n JOIN chunks c ON n.id = c.id""",
    ),
)
def search_decorated(r: Roles) -> DataFrame:
    return hybrid.decorate(hybrid.hybrid_search(r.text_index(), r.chunks(), r.queries(), "rrf", cutoff=CUTOFF, payload=r.texts()))


RERANK = {
    "found": """SELECT h.query_id, h.id, sum(idf) AS weight, sum(part) AS bm25 FROM hits h JOIN numbered n
        ON h.query_id = n.query_id AND h.id = n.id GROUP BY h.query_id, h.id""",
    "totals": "SELECT query_id, sum(idf) AS query_weight FROM weighted WHERE df IS NOT NULL GROUP BY query_id",
    "reranked": """SELECT n.query_id, n.id, n.rank_id, n.retrieval_method,
        round(coalesce(weight / query_weight, 0.0::DOUBLE), 9) + 0.0 AS rerank_score, round(coalesce(bm25, 0.0::DOUBLE), 9) + 0.0 AS bm25
        FROM numbered n LEFT JOIN found f ON n.query_id = f.query_id AND n.id = f.id LEFT JOIN totals t ON n.query_id = t.query_id""",
    "best": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, bm25 DESC, rank_id) AS rn
        FROM reranked QUALIFY rn <= 10""",
}


@query(
    "hybrid_rerank",
    fused_sql(
        RRF,
        100,
        100,
        f"""SELECT query_id, b.id, rank_id, rn, rerank_score, bm25,
        retrieval_method, {PAYLOAD} FROM best b JOIN chunks c ON b.id = c.id""",
        more=RERANK,
    ),
)
def hybrid_rerank(r: Roles) -> DataFrame:
    return hybrid.hybrid_search(r.text_index(), r.chunks(), r.queries(), "rerank", cutoff=CUTOFF, payload=r.texts()).drop("score")


@query(
    "candidate_arrays",
    fused_sql(
        RRF,
        100,
        100,
        """SELECT query_id, count(*) AS n_documents, md5(string_agg(chunk_text, '|' ORDER BY rank_id)) AS digest
        FROM numbered n JOIN chunks c ON n.id = c.id GROUP BY query_id""",
    ),
)
def candidate_arrays(r: Roles) -> DataFrame:
    queries = r.queries()
    top = hybrid.hybrid_candidates(r.text_index(), r.chunks(), queries, 100, 100, "rrf", CUTOFF)
    arrays = hybrid.candidate_arrays(top, r.texts(), 100 * queries.count())
    return arrays.select(
        "query_id", F.size("documents").cast("long").alias("n_documents"), F.md5(F.array_join("documents", "|")).alias("digest")
    )


SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(
    "chunk_summaries",
    with_roles(
        "stop",
        more={
            "sentences": f"""SELECT id, no, sentence FROM (SELECT doc_id AS id, generate_subscripts(s, 1) - 1 AS no, unnest(s) AS sentence
                FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)) WHERE trim(sentence) <> ''""",
            "words": r"""SELECT id, no, term FROM (SELECT id, no, unnest(regexp_split_to_array(lower(sentence), '[^\p{L}\p{N}]+')) AS term
                FROM sentences) WHERE term <> '' AND term NOT IN (SELECT term FROM stop)""",
            "tf": "SELECT id, term, count(*) AS tf FROM words GROUP BY id, term",
            "idf": "SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term",
            "scored": """SELECT id, no, round(avg(tf * idf), 9) + 0.0 AS score FROM words JOIN tf USING (id, term) JOIN idf USING (term)
                GROUP BY id, no""",
            "best": """SELECT id, no, row_number() OVER (PARTITION BY id ORDER BY coalesce(score, 0.0) DESC, no) AS rn
                FROM sentences LEFT JOIN scored USING (id, no) QUALIFY rn <= 3""",
        },
        body="""SELECT id, string_agg(sentence, ' ' ORDER BY no) AS summary FROM best JOIN sentences USING (id, no) GROUP BY id""",
    ),
)
def chunk_summaries(r: Roles) -> DataFrame:
    return summarize(r.table("documents").select(F.col("doc_id").alias("id"), "text"))


# --- all modes through one entry -----------------------------------------------------------------


@query(
    "hybrid_rrf_cells",
    fused_sql(
        RRF,
        20,
        10,
        f"""SELECT query_id, CAST(n.id AS VARCHAR) AS id, round(score, 4) + 0.0 AS score, retrieval_method, {PAYLOAD}
        FROM numbered n JOIN chunks c ON n.id = c.id""",
    ),
)
def hybrid_rrf_cells(r: Roles) -> DataFrame:
    """The hybrid search over the stored cells, all of them probed: equal to the exact scan."""
    cells = vector_search.build_ivf(r.chunks(), 8, work_dir(r.spark, "cells"))
    tables = SearchTables(r.text_index(), r.chunks(), r.texts(), cells)
    found = search(tables, r.queries(), "hybrid", "cells", "bm25", "rrf", CUTOFF, nprobe=8)
    return found.drop("type").withColumnRenamed("text", "chunk_text")


@query(
    "analyze_hits",
    with_roles(
        "matched",
        "hits",
        "stop",
        more={
            "pool": TEXT_POOL.format(score="score", k=10),
            "why": """SELECT p.query_id, p.id, p.rn, string_agg(term, ', ' ORDER BY round(h.part / p.score, 6) DESC, term) AS explanation
                FROM hits h JOIN pool p ON h.query_id = p.query_id AND h.id = p.id GROUP BY p.query_id, p.id, p.rn""",
            "sentences": f"""SELECT id, no, sentence FROM (SELECT doc_id AS id, generate_subscripts(s, 1) - 1 AS no, unnest(s) AS sentence
                FROM (SELECT doc_id, {SENTENCES} AS s FROM documents WHERE doc_id IN (SELECT id FROM pool))) WHERE trim(sentence) <> ''""",
            "words": r"""SELECT id, no, term FROM (SELECT id, no, unnest(regexp_split_to_array(lower(sentence), '[^\p{L}\p{N}]+')) AS term
                FROM sentences) WHERE term <> '' AND term NOT IN (SELECT term FROM stop)""",
            "scored": """SELECT w.id, no, round(avg(tf * ln(n_docs::DOUBLE / df)), 9) + 0.0 AS score FROM words w
                JOIN (SELECT id, term, count(*) AS tf FROM words GROUP BY id, term) t ON w.id = t.id AND w.term = t.term
                JOIN vocabulary v ON v.term = w.term CROSS JOIN stats GROUP BY w.id, no""",
            "best": """SELECT id, no, row_number() OVER (PARTITION BY id ORDER BY coalesce(score, 0.0) DESC, no) AS rn
                FROM sentences LEFT JOIN scored USING (id, no) QUALIFY rn <= 3""",
            "summaries": "SELECT id, string_agg(sentence, ' ' ORDER BY no) AS summary FROM best JOIN sentences USING (id, no) GROUP BY id",
        },
        body="SELECT * FROM why JOIN summaries USING (id)",
    ),
)
def analyze_hits(r: Roles) -> DataFrame:
    return explain_hits(r.text_index(), r.texts(), r.queries())
