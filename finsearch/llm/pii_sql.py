"""The statement of the personal-data query: plain patterns, positions by running lengths, counts over all documents."""

from __future__ import annotations

from finsearch.llm.pii import GENERALISE, PRIOR

SPACE = r"\x20\x09-\x0D"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
# every second digit from the right is doubled, and nine taken off if that has two digits
LUHN = f"""list_sum(list_transform(range(length({DIGITS})), lambda i:
    CASE WHEN i % 2 = 0 THEN substr(reverse({DIGITS}), i + 1, 1)::INTEGER
         ELSE 2 * substr(reverse({DIGITS}), i + 1, 1)::INTEGER - CASE WHEN substr(reverse({DIGITS}), i + 1, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(value, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(p AS HUGEINT), 256) <= 255))",
    "card": f"length({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
}
NORMAL = {"email": "lower(value)", "ip": "value", "card": DIGITS, "phone": DIGITS}


def positions(table: str, text: str, pattern: str, more: str) -> str:
    """``(more, value, s, e)`` of all matches in a column."""
    return f"""SELECT {more}, m[i] AS value,
            coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
            s + length(m[i]) AS e
        FROM (SELECT {more}, m, g, unnest(range(1, len(m) + 1)) AS i
              FROM (SELECT {more}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g FROM {table}))"""


def statement() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {no} AS no, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, '{kind}:' || {NORMAL[kind]} AS entity "
        f"FROM ({positions('d', 'text', PATTERNS[kind], 'doc_id')}) WHERE {VALID[kind]}"
        for no, kind in enumerate(PATTERNS)
    )
    part, joint, sign = r"[\p{L}\p{M}\p{N}]", r"[''\x{2019}\x{2010}\x{2011}-]", rf"[^\p{{L}}\p{{M}}\p{{N}}{SPACE}]"
    core = f"{part}+(?:{joint}{part}+)*"
    is_term = f"regexp_full_match(piece, '{sign}*{core}{sign}*') AND length(regexp_extract(piece, '{core}')) > 1 AND regexp_matches(piece, '\\p{{L}}')"
    pieces = f"unnest(regexp_extract_all(text, '[{SPACE}]+|[^{SPACE}]+'))"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    base AS MATERIALIZED ({kinds}),
    has AS MATERIALIZED (
        SELECT term, count(DISTINCT doc_id) AS n_term
        FROM (SELECT doc_id, lower(regexp_extract(piece, '{core}')) AS term FROM (SELECT doc_id, {pieces} AS piece FROM d) WHERE {is_term}) GROUP BY term
    ), places AS MATERIALIZED (
        SELECT doc_id, lower(regexp_extract(piece, '{core}')) AS term, off + length(regexp_extract(piece, '^{sign}*')) AS s, s + length(regexp_extract(piece, '{core}')) AS e
        FROM (SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(piece) AS off
              FROM (SELECT doc_id, {pieces} AS piece, generate_subscripts(regexp_extract_all(text, '[{SPACE}]+|[^{SPACE}]+'), 1) AS i
                    FROM d WHERE doc_id IN (SELECT doc_id FROM base)))
        WHERE {is_term}
    ), holds AS (SELECT DISTINCT doc_id, entity, split_part(entity, ':', 1) AS kind, text FROM base JOIN d USING (doc_id)),
    own AS (SELECT DISTINCT doc_id, term FROM places),
    pairs AS (SELECT entity, kind, term, count(DISTINCT text) AS n_both FROM holds JOIN own USING (doc_id) GROUP BY entity, kind, term),
    usual AS (
        SELECT kind, term, n AS kind_both, n_kind AS kind_texts
        FROM (SELECT kind, term, count(DISTINCT text)::DOUBLE AS n FROM holds JOIN own USING (doc_id) GROUP BY kind, term)
        JOIN (SELECT kind, count(DISTINCT text) AS n_kind FROM holds GROUP BY kind) USING (kind)
    ), holders AS (SELECT entity, count(DISTINCT doc_id) AS n_entity, count(DISTINCT text) AS texts FROM holds GROUP BY entity),
    total AS (SELECT count(*) AS n_all FROM d),
    revealing AS (
        SELECT entity, term FROM pairs JOIN usual USING (kind, term) JOIN holders USING (entity) JOIN has USING (term) CROSS JOIN total
        WHERE n_all > n_entity AND round(log2((n_both + {PRIOR} * CASE WHEN kind_texts > texts THEN (kind_both - n_both) / (kind_texts - texts) ELSE 0 END) / (texts + {PRIOR}) * n_all / n_term) / log2(n_all::DOUBLE / n_entity), 9) >= {GENERALISE}
    ), terms AS (
        SELECT DISTINCT doc_id, 4 AS no, 'term' AS kind, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e
        FROM places JOIN holds USING (doc_id) JOIN revealing USING (entity, term)
        WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = places.doc_id AND b.s < places.e AND places.s < b.e)
    ), listed AS (
        SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) AS spans
        FROM (SELECT doc_id, no, kind, s, e FROM base UNION ALL SELECT * FROM terms) GROUP BY doc_id
    ), counted AS (
        SELECT doc_id, count(*) FILTER (no = 0) AS n_email, count(*) FILTER (no = 1) AS n_ip, count(*) FILTER (no = 2) AS n_card,
               count(*) FILTER (no = 3) AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e) AS spans
        FROM base GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
           sha256(coalesce(c.spans, '')) AS base_sha256, coalesce(l.spans, '') AS spans
    FROM d LEFT JOIN counted c USING (doc_id) LEFT JOIN listed l USING (doc_id)
    """
