"""Personal data by patterns, and terms that reveal it, with Spark expressions only.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities.
A term in a document of an entity reveals it as far as the corpus says so: its pointwise mutual information
with the entity, log2(p(t | e) / p(t)), against the information of the entity itself, -log2 p(e).
Most entities are seen in one text or two, so p(t | e) is shrunken to what the terms of its kind of entity
are: one further text that has the term as often as the other texts of that kind do. Terms that give away more
than a share of the information are generalised, those that give away nearly all of it are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsearch.llm.common import blocks_of, once, scan, span_of, text_of
from finsearch.session import written

KINDS = ["email", "ip", "card", "phone", "term"]
# What counts as personal data. Each pattern takes what the plain one takes, in linear
# time: runs are possessive, and a run is entered at its start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
# whole chains of digits of the right length only: shorter and longer ones fail anyway
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+(?=[0-9])(?:[\x20().-]*+[0-9]){10,15}+(?![\x20().-]*+[0-9])"
SPACE = r"\x20\x09-\x0D"
# a token of letters, digits and marks, joined by inner hyphens and apostrophes, with any signs around it; one letter at least
_SIGN = rf"[^\p{{L}}\p{{M}}\p{{N}}{SPACE}]"
_PART = r"[\p{L}\p{M}\p{N}]"
_JOIN = r"['\u2019\u2010\u2011-]"
TERM = rf"(?<![^{SPACE}]){_SIGN}*+(?={_PART}(?:{_PART}|{_JOIN}{_PART}))(?=(?:[\p{{M}}\p{{N}}]|{_JOIN})*+\p{{L}})({_PART}++(?:{_JOIN}{_PART}++)*+){_SIGN}*+(?![^{SPACE}])"

PRIOR = 1  # texts that the kind of an entity counts for beside its own
PART_TEXTS = 4096  # texts of one entity that meet its terms together, about
GENERALISE, REMOVE = 0.8, 0.95  # shares of an entity's information that a term may not reach

SPAN = "struct<start:bigint,kind_no:int,end:bigint>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start, end, value>>`` of all matches; positions in code points, end exclusive."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def step(at: Column, pair: Column) -> Column:
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        found = F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value")))
        return F.struct(F.coalesce(end, start).alias("state"), F.when(pair["hit"].isNull(), empty).otherwise(found).alias("out"))

    return scan(pairs, F.lit(0).cast("long"), step, empty)


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        digit = F.reverse(digits).substr((i + 1).cast("int"), F.lit(1)).cast("int")
        return F.when(i % 2 == 0, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    values = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value)
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def entities(text: Column) -> Column:
    """``array<struct<start, kind_no, end, entity>>`` of the personal data, in order; ``entity`` is its normal form."""

    def of(kind: str, pattern: str, valid, normal, asked: Column) -> Column:
        found = matches(F.when(asked, text).otherwise(F.lit("")), pattern)
        found = F.filter(found, lambda m: valid(m["value"])) if valid else found
        no = F.lit(KINDS.index(kind))
        return F.transform(
            found,
            lambda m: F.struct(m["start"].alias("start"), no.alias("kind_no"), m["end"].alias("end"), F.concat(F.lit(f"{kind}:"), normal(m["value"])).alias("entity")),
        )

    digits = lambda value: F.regexp_replace(value, "[^0-9]", "")
    parts = lambda value: F.forall(F.split(value, r"\."), lambda p: p.rlike(IP_PART))
    some_digit = F.translate(text, "0123456789", "") != text
    found = F.concat(
        of("email", EMAIL, None, F.lower, F.contains(text, F.lit("@"))),
        of("ip", IP, parts, lambda v: v, some_digit & F.contains(text, F.lit("."))),
        of("card", CARD, lambda v: _luhn(digits(v)), digits, some_digit),
        of("phone", PHONE, None, digits, F.contains(text, F.lit("+"))),
    )
    return F.sort_array(found)


def terms_of(text: Column) -> Column:
    """``array<string>``: the different terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(1)), lambda t: F.lower(t)))


def term_spans(text: Column, marks: Column) -> Column:
    """``array<struct<start, end, removed>>``: every occurrence of the terms that ``marks``, a map of term to ``removed``, has."""
    pairs = F.arrays_zip(
        F.split(text, TERM, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(TERM), F.lit(1)).alias("term")
    )

    empty = F.array().cast("array<struct<start:bigint,end:bigint,removed:boolean>>")

    def step(place: Column, pair: Column) -> Column:
        at = place + F.length(pair["gap"])
        start = at + F.length(F.regexp_extract(pair["hit"], rf"^{_SIGN}*+", 0))
        removed = F.element_at(marks, F.lower(pair["term"]))
        found = F.array(F.struct(start.alias("start"), (start + F.length(pair["term"])).alias("end"), removed.alias("removed")))
        return F.struct(F.coalesce(at + F.length(pair["hit"]), at).alias("state"), F.when(removed.isNull(), empty).otherwise(found).alias("out"))

    return scan(pairs, F.lit(0).cast("long"), step, empty)


def _held_texts(held: DataFrame) -> DataFrame:
    """A written table of a row per text and entity: ``(text_hash, words, entity, kind, n_entity, texts)``, the documents and texts of the entity with it.

    ``held(text_hash, entities array<long>, words)`` are the documents with entities, whose last two bits are the kind. Equal texts have one row.
    """
    texts = held.groupBy("text_hash").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    rows = texts.select("text_hash", "n", "words", F.explode("entities").alias("entity")).withColumn("kind", F.col("entity").bitwiseAND(3).cast("int"))
    holders = rows.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"))
    return written(rows.drop("n").join(holders, "entity"), "held-texts")


def disclosing(holds: DataFrame, docs: DataFrame, text_col: str, generalise: float = GENERALISE, prior: float = PRIOR) -> DataFrame:
    """``(entity, term, texts, share)``: terms that reveal at least a share of an entity's information, of ``_held_texts``.

    Evidence for a pair are different texts, so that copies alone reveal nothing; how rare terms and
    entities are is counted in documents. An entity that every document has tells nothing.
    """
    first = [F.first(c).alias(c) for c in ("kind", "n_entity", "texts")]
    both = holds.select("entity", "kind", "n_entity", "texts", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"), *first)
    by_kind = holds.groupBy("text_hash", "kind").agg(F.first("words").alias("words"))
    kinds = by_kind.groupBy("kind").agg(F.count("*").alias("kind_texts"))
    of_kind = [F.count(F.when(F.col("kind") == i, 1)).alias(f"k{i}") for i in range(len(KINDS) - 1)]
    kind_counts = by_kind.select("kind", F.explode("words").alias("term")).groupBy("term").agg(*of_kind)
    # counted per task before the join, which a semi join would not be: a term that every document has is a row per task
    counts = docs.select(F.explode(terms_of(text_of(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.agg(F.count("*").alias("n_all"))
    known = counts.join(kind_counts, "term").join(both, "term").join(F.broadcast(kinds), "kind").crossJoin(F.broadcast(total))
    own = F.log2(F.col("n_all") / F.col("n_entity"))
    kind_both = F.get(F.array(*[f"k{i}" for i in range(len(KINDS) - 1)]), F.col("kind"))
    others = F.col("kind_texts") - F.col("texts")
    usual = F.when(others > 0, (kind_both - F.col("both")) / others).otherwise(F.lit(0.0))
    likely = (F.col("both") + prior * usual) / (F.col("texts") + prior)
    pmi = F.log2(likely * F.col("n_all") / F.col("n_term"))
    share = F.when(own > 0, F.round(pmi / own, 9)).otherwise(F.lit(0.0))
    return known.select("entity", "term", "texts", share.alias("share")).where(F.col("share") >= generalise)


def revealed(holds: DataFrame, revealing: DataFrame) -> DataFrame:
    """``(text_hash, marks)``: the text's own terms that one of its entities makes telling, as a map of term to whether it is removed.

    The texts of a common entity are dealt to parts.
    """
    parts = F.ceil(F.col("texts") / PART_TEXTS).cast("int")
    pair = F.xxhash64("entity", "term").alias("pair")
    asked = holds.select("text_hash", "entity", F.pmod(F.col("text_hash"), parts).cast("int").alias("part"), F.explode("words").alias("term")).select("text_hash", pair, "part", "term")
    telling = revealing.select(pair, (F.col("share") >= REMOVE).alias("removed"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = asked.join(telling, ["pair", "part"]).groupBy("text_hash", "term").agg(F.max("removed").alias("removed"))
    return met.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("marks"))


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, entities, terms)`` of every row: all personal data, and the terms that reveal it.

    ``terms`` is ``array<struct<start, end, removed>>``: every occurrence, near or far, of a term that reveals an
    entity of the document. Null and empty texts have neither. Rows are matched
    with their terms by id and text: repeated rows get equal results, null ids get theirs.
    """
    text = text_of(text_col)
    first = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), entities(text).alias("entities"))
    # the text stays only where there is something to find in it
    base = written(first.withColumn("text", F.when(F.size("entities") > 0, F.col("text"))), "entities")
    # numbers are told apart by a hash set, structs pair by pair: the kind stands in the last bits of the entity's hash
    own = F.array_distinct(F.transform("entities", lambda e: F.xxhash64(e["entity"]).bitwiseAND(-4).bitwiseOR(e["kind_no"].cast("long"))))
    holds = _held_texts(base.where("text is not null").select("text_hash", own.alias("entities"), terms_of(F.col("text")).alias("words")))
    marks = revealed(holds, disclosing(holds, docs.select(text_col), text_col))
    # the rows of a text are told apart by their id, so that many copies are not one key
    ids = base.where("text is not null").select("id", "text_hash").distinct()
    terms = ids.join(marks, "text_hash").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "marks")
    same = base["id"].eqNullSafe(terms["_id"]) & (base["text_hash"] == terms["_hash"])
    none = F.array().cast("array<struct<start:bigint,end:bigint,removed:boolean>>")
    clear = lambda t: ~F.exists("entities", lambda e: (e["start"] < t["end"]) & (t["start"] < e["end"]))
    found = F.when(F.col("marks").isNotNull(), term_spans(F.col("text"), F.col("marks")))
    return base.join(terms, same, "left").select(
        F.col("id").alias(id_col), "text_hash", "entities", F.filter(F.coalesce(found, none), clear).alias("terms")
    )


def span_list(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def base_spans() -> Column:
    return F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["kind_no"].alias("kind_no"), e["end"].alias("end")))


def all_spans() -> Column:
    term = F.lit(KINDS.index("term"))
    return F.concat(base_spans(), F.transform("terms", lambda t: F.struct(t["start"].alias("start"), term.alias("kind_no"), t["end"].alias("end"))))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities and revealing terms replaced in the text, all other columns and rows as they are.

    An entity becomes its kind in brackets, a generalised term ``[TERM]``, a removed one nothing. Of
    overlapping spans the first counts. A text without any stays as it is, null included.
    """
    found = found_in(docs.select(id_col, text_col), id_col, text_col).where("size(entities) > 0").dropDuplicates([id_col, "text_hash"])
    found = found.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), F.col("entities"), F.col("terms"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    marks = F.sort_array(
        F.concat(
            F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.get(names, e["kind_no"]).alias("mark"))),
            F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("mark"))),
        )
    )
    found = found.select("_id", "_hash", marks.alias("_marks"))
    held = docs.withColumn("_text_hash", F.xxhash64(text_of(text_col)))
    same = held[id_col].eqNullSafe(found["_id"]) & (held["_text_hash"] == found["_hash"])
    joined = held.join(found, same, "left")

    def rewritten(blocks: Column) -> Column:
        none = F.array().cast("array<string>")

        def step(at: Column, m: Column) -> Column:
            piece = F.concat(span_of(blocks, at, m["start"] - at), m["mark"])
            inside = m["start"] < at
            return F.struct(F.when(inside, at).otherwise(m["end"]).alias("state"), F.when(inside, none).otherwise(F.array(piece)).alias("out"))

        # the end of the text as a last mark that replaces nothing
        end = F.struct(F.length(text_col).cast("long").alias("start"), F.length(text_col).cast("long").alias("end"), F.lit("").alias("mark"))
        return F.array_join(scan(F.concat("_marks", F.array(end)), F.lit(0).cast("long"), step, none), "")

    text = F.when(F.col("_marks").isNull(), F.col(text_col)).otherwise(once(blocks_of(F.col(text_col)), rewritten))
    return joined.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
