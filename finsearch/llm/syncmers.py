"""Document fingerprints from closed syncmers, with Spark expressions only.

The units of a text are its code points without white space. Of all runs of K units, one from every
unit on, those are anchors whose smallest inner run of S units stands at the left or right edge. Whether
a run is an anchor depends on its own units alone, so an unchanged passage keeps its anchors wherever it
moves, by however few characters. ``anchored`` gives all of them with their positions. For a fingerprint
they are dealt by their hash to a fixed number of bins, and it has the smallest anchor of each bin. Bins
that agree estimate the share of anchors two texts have in common.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsearch.llm.common import once, ranked, text_of

K, S = 15, 6
INNER = K - S + 1  # runs of S units in a run of K
UNIT = r"\S"
BIN_BITS = 7  # 128 bins; a fingerprint has at most 8 hex digits for each


def units_of(text: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(text, r"\s+", "")


def _closed(units: Column) -> Column:
    """``array<struct<place, anchor>>`` of the closed syncmers; none in fewer than K units."""

    def from_runs(r: Column) -> Column:
        def closed(y: Column, i: Column) -> Column:
            # compared one by one, so that most places are done after three or four; what lacks its last run is none
            return reduce(and_, [*[y <= F.get(r, i + j) for j in range(1, INNER - 1)], i <= F.size(r) - INNER])

        hashed = lambda i: F.xxhash64(*[F.get(r, i + j) for j in range(0, INNER, S)], F.get(r, i + INNER - 1))
        one = lambda i: F.struct(i.alias("place"), F.shiftright(hashed(i), 32).cast("int").alias("anchor"))
        edges = F.zip_with(r, F.slice(r, F.lit(INNER), F.size(r)), lambda x, y: F.least(x, y))
        return F.filter(F.transform(edges, lambda y, i: F.when(closed(y, i), one(i))), lambda p: p.isNotNull())

    # a code point is taken at a time, and the S units from it on are looked at
    runs = F.regexp_extract_all(units, F.lit(f"(?s)(?=(.{{{S}}}))."), F.lit(1))
    return once(F.transform(runs, lambda x: F.xxhash64(x)), from_runs)


def placed(units: Column) -> Column:
    """``array<struct<place, anchor>>`` of a text without white space: all closed syncmers and the unit that each starts at.

    Texts of fewer than K units are one anchor, empty ones none.
    """
    short = F.array(F.struct(F.lit(0).alias("place"), F.shiftright(F.xxhash64(units), 32).cast("int").alias("anchor")))
    size = F.length(units)
    return F.when(size >= K, _closed(units)).when(size > 0, short).otherwise(F.array().cast("array<struct<place:int,anchor:int>>"))


def anchors(units: Column) -> Column:
    """``array<int>``: hashes of the closed syncmers of an array of units, in their order."""
    return once(F.array_join(units, ""), placed)["anchor"]


def anchored(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``anchors``, an ``array<struct<start, end, anchor>>``: all anchors with their code points in the text, end exclusive.

    Null, empty and blank texts have none; texts of fewer than K units have one. Texts are read whole.
    Repeated rows get equal anchors, an empty table gives no rows, and a column ``anchors`` is replaced.
    """
    text = text_of(text_col)
    letters = F.split(text, "")

    def of(at: Column) -> Column:
        end = lambda p: F.get(at, F.least(p["place"] + K, F.size(at)) - 1) + 1
        return F.transform(placed(units_of(text)), lambda p: F.struct(F.get(at, p["place"]).alias("start"), end(p).alias("end"), p["anchor"].alias("anchor")))

    # the code point of every unit
    at = once(letters, lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i).rlike(UNIT)))
    return docs.withColumn("anchors", once(at, of))


def _bin(anchor: Column) -> Column:
    return F.shiftright(anchor, 32 - BIN_BITS)


def smallest(found: Column) -> Column:
    """``array<int>``: of anchors, the smallest of every bin that has one, in order of the bins."""
    return once(F.sort_array(found), lambda rows: F.filter(rows, lambda a, i: (i == 0) | (_bin(a) != _bin(F.get(rows, i - 1)))))


def fingerprint(text: Column) -> Column:
    """``array<int>``: the smallest anchor of every bin that has one, in order of the bins. Empty texts have none."""
    return smallest(once(units_of(text), placed)["anchor"])


def _within(found: Column, units: Column) -> Column:
    """The fingerprint of the first ``units`` units, as far as whole syncmers lie in them."""
    return smallest(F.filter(found, lambda p: p["place"] + K <= units)["anchor"])


def as_text(prints: Column) -> Column:
    """A fingerprint as hex digits, eight for every bin."""
    return F.array_join(F.transform(prints, lambda a: F.lower(F.right(F.concat(F.lit("0000000"), F.hex(a)), F.lit(8)))), "")


def likeness(one: Column, other: Column) -> Column:
    """The estimated share of common anchors in two texts, 0 to 1; two texts without any are alike.

    With J as the share of agreeing bins among those either text fills, it is 2 J / (1 + J): one half
    if half of either text is in the other.
    """
    bins = F.size(F.array_distinct(F.transform(F.concat(one, other), _bin)))
    share = F.size(F.array_intersect(one, other)) / bins
    return F.when(bins == 0, F.lit(1.0)).otherwise(2 * share / (1 + share))


def fingerprinted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, an ``array<int>``; null, empty and blank texts have an empty one.

    Equal texts have equal fingerprints, whatever their length. An empty table gives no rows; a column ``fingerprint`` is replaced.
    """
    return docs.withColumn("fingerprint", fingerprint(text_of(text_col)))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text with its edited text and its next one: ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id)``.

    The next text is that of the next smaller id, after the smallest that of the largest; null ids
    come last, equal ids are ordered by a hash of the text. The edited text has its last half of code
    points, rounded down, replaced by the first as many of the next text, or by all of it. Null texts are
    empty. Repeated rows have one place in the order, and each gets its result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("none")), F.col("hash").cast("string"))
    rows = rows.withColumn("key", key)
    keys = rows.groupBy("key").agg(F.first("id").alias("id"), F.first("hash").alias("hash"), F.first(F.length("text")).cast("long").alias("n"))
    order, total = ranked(keys, [F.col("id").desc_nulls_last(), F.col("hash")], "order")
    # the text before this one in the order is given the start of it, half its own length
    given_to = order.select(
        F.pmod(F.col("rank") + 1, F.lit(max(total, 1))).alias("rank"), F.col("key").alias("to"), F.floor(F.col("n") / 2).cast("int").alias("asked")
    )
    places = order.join(given_to, "rank").select("key", "to", "asked")
    held = rows.join(places, "key").select("key", "to", "id", "text", "asked")
    # a row per text gives; the texts that are given to lie by their key already and are not shuffled again
    given = held.groupBy("key").agg(F.first("to").alias("to"), F.first(F.expr("left(text, asked)")).alias("tail"), F.first("id").alias("next_id"))
    met = held.select("key", "to", "id", "text").join(given.select(F.col("to").alias("key"), "tail", "next_id"), "key")
    half = F.expr("left(text, cast(length(text) - floor(length(text) / 2) as int))")
    # both halves of an edited text keep their anchors: of the first one they are known, and the second is cut with the
    # last K - 1 units before it
    met = met.withColumn("units", units_of(F.col("text"))).withColumn("kept", F.length(units_of(half))).withColumn("found", placed(F.col("units")))
    met = met.withColumn("before", F.expr(f"right(left(units, kept), {K - 1})")).withColumn("after", units_of(F.col("tail")))
    new = F.concat("before", "after")
    met = met.withColumn("new", F.when((F.length(new) < K) & (F.col("kept") + F.length("after") >= K), F.lit("")).otherwise(new))
    edited = met.select(
        "key", "to", "id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.concat(half, "tail"), 256).alias("edited_sha256"),
        smallest(F.col("found")["anchor"]).alias("print"), _within(F.col("found"), F.col("kept")).alias("kept_print"), placed(F.col("new"))["anchor"].alias("across"),
    )
    edited = edited.withColumn("edited_print", smallest(F.concat("kept_print", "across")))
    # every text is worked out once, and sends a row for itself and one to the text that it comes after
    kept = ["id", "next_id", "n_chars", "edited_sha256", "print", "edited_print"]
    own = F.struct(F.col("key").alias("at"), F.struct(*kept).alias("t"), F.lit(None).cast("array<int>").alias("next"))
    other = F.struct(F.col("to").alias("at"), F.lit(None).cast(edited.select(F.struct(*kept)).schema[0].dataType).alias("t"), F.col("print").alias("next"))
    sent = edited.select(F.inline(F.array(own, other))).repartition("at")
    pairs = sent.groupBy("at").agg(F.count("t").cast("int").alias("rows"), F.first("t", ignorenulls=True).alias("t"), F.first("next", ignorenulls=True).alias("next"))
    result = pairs.select(
        F.col("t.id").alias(id_col),
        F.col("t.n_chars").alias("n_chars"),
        F.col("t.edited_sha256").alias("edited_sha256"),
        as_text(F.col("t.print")).alias("fingerprint"),
        as_text(F.col("t.edited_print")).alias("edited_fingerprint"),
        likeness(F.col("t.print"), F.col("t.edited_print")).alias("near_edited"),
        likeness(F.col("t.print"), F.col("next")).alias("near_next"),
        F.col("t.next_id").alias(f"next_{id_col}"),
        F.col("rows").alias("_rows"),
    )
    # repeated rows were worked out alike
    return result.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows")))).drop("_rows", "_row")
