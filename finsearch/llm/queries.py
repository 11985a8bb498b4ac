"""The named queries of the text operators over the given tables, and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsearch.llm import alignment, bpe, chat, extraction, langid, language_model, lexical, packing, pii, pii_sql, quality, simhash, syncmers, warc
from finsearch.session import work_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.written_pieces(table(spark, folder, "documents"), TOKENIZER)
    return packing.with_places(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op2_syncmer_fingerprints")
def syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.edited_and_next(table(spark, folder, "documents"))


@query(
    "op3_warc_reassembly",
    """
    WITH p AS (
        SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
    ), stored AS (SELECT hex, max(page_id) AS kept FROM p GROUP BY hex),
    bits AS (
        SELECT hex, string_agg(bin, '' ORDER BY i) AS bits
        FROM (SELECT hex, i, lpad(bin(cast(('0x' || substr(hex, 1 + 5 * i, 5)) AS INTEGER)), 20, '0') AS bin
              FROM stored, range(8) r(i)) GROUP BY hex
    ), digests AS (
        SELECT hex, array_to_string(list_transform(range(32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j:
                cast(substr(bits, cast(1 + 5 * i + j AS INTEGER), 1) AS INTEGER) * cast(pow(2, 4 - j) AS INTEGER)))::INTEGER, 1)), '') AS digest
        FROM bits
    )
    SELECT page_id, cast(octet_length(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> kept THEN kept END AS refers_to
    FROM p JOIN stored USING (hex) JOIN digests USING (hex)
    """,
)
def warc_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    # looked up by the revisits too: written once, instead of reading the archives again
    records = written(warc.decoded(warc.reassembled(warc.read_archives(spark, path)), with_payload=False), "records")
    return warc.page_records(records).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


SHINGLE, MAX_BITS = 4, 4


@query("op4_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(table(spark, folder, "documents"), SHINGLE, MAX_BITS)
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op5_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extracted(table(spark, folder, "pages"))


@query(
    "op6_quality_rules",
    r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(text, '') AS text,
               list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), windows AS (
        SELECT doc_id, i, array_to_string(words[i:i + 7], chr(10)) AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
    ), twice AS (
        SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
    ), repeated AS (SELECT doc_id, cast(sum(least(8, coalesce(next - i, 8))) AS BIGINT) AS n FROM twice GROUP BY doc_id),
    base AS (
        SELECT d.doc_id, cast(len(words) AS BIGINT) AS n_words,
               cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
               cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               coalesce(n, 0) AS n_repeat_words
        FROM d LEFT JOIN repeated USING (doc_id)
    ), line AS (
        SELECT doc_id, source, text, l, regexp_replace(lower(trim(l, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))), '[0-9]+', '0', 'g') AS line
        FROM (SELECT doc_id, source, text, unnest(lines) AS l FROM d)
    ), common AS (
        SELECT source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM line GROUP BY source, line)
        JOIN (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source) USING (source)
        WHERE n >= 10 AND (n >= 0.02 * texts OR n >= 200)
    ), depleted AS (
        SELECT doc_id, sum(length(l)) FILTER (common.line IS NULL) AS remain, sum(length(l)) AS total
        FROM line LEFT JOIN common USING (source, line) GROUP BY doc_id
    )
    SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
           AND NOT coalesce(coalesce(remain, 0) < 0.3 * total, false) AS kept
    FROM base LEFT JOIN depleted USING (doc_id)
    """,
)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).drop("text_hash", "removed")


@query(
    "op7_chat_formatting",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), marked AS (
        SELECT *, length(regexp_replace(text, '(\\*)(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<<ROLE |<</ROLE>>)', '\\\1\2', 'g')) AS escaped,
               CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3 ELSE 9 + length(url_encode(role)) END AS opening,
               CASE role WHEN 'system' THEN 8 WHEN 'user' THEN 7 WHEN 'assistant' THEN 4 ELSE 9 END AS closing,
               role IS DISTINCT FROM lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(cast(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           cast(sum(opening + 1 + escaped + CASE WHEN last THEN 1 + closing ELSE 0 END) + count(*) - 1 AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id
    """,
)
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.masked_text(chat.read_back(chat.formatted(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def language_filter(docs: DataFrame) -> langid.LanguageFilter:
    return langid.learn(docs.where(~langid.held_out()))


@query("op8_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    asked = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(asked, language_filter(docs)).drop("text")


@query("op9_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), TOKENIZER)


@query("op10_information_theoretic_pii", pii_sql.statement())
def information_theoretic_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.found_in(table(spark, folder, "documents"))
    number = lambda kind: F.size(F.filter("entities", lambda e: e["kind_no"] == pii.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]],
        F.sha2(pii.span_list(pii.base_spans()), 256).alias("base_sha256"),
        pii.span_list(pii.all_spans()).alias("spans"),
    )


@query("op11_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents"), TOKENIZER, public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_attention_scores")
def attention_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.scored(table(spark, folder, "documents"), TOKENIZER)


@query(
    "op13_ranked_lexical_search",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS doc, doc_id, list_transform(
            regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
            lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents
    ), q AS (
        SELECT item, item_id, term, count(*) AS n FROM (
            SELECT item, item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)) GROUP BY item, item_id, term
    ), held AS (
        SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY doc, term
    ), s AS (SELECT count(*) AS docs, cast(sum(len(terms)) AS BIGINT) AS length FROM d WHERE len(terms) > 0),
    w AS (SELECT term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, s GROUP BY term, docs),
    m AS (SELECT doc, doc_id, 75 + (25 * len(terms) * docs) // length AS m FROM d, s WHERE len(terms) > 0),
    scores AS (
        SELECT item, item_id, doc_id, cast(sum(n * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN held USING (term) JOIN m USING (doc) GROUP BY item, item_id, doc, doc_id
    )
    SELECT item_id, cast(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
    """,
)
def ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "benchmark"), table(spark, folder, "documents"))
