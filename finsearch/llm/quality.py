"""Quality rules over words and lines, with Spark expressions only.

A document is judged by its own words first. Then every line is hashed in a normal form, the
distinct documents that have it are counted per host, lines above the limit are removed as
boilerplate, and documents of which too little is left are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsearch.llm.common import once, text_of
from finsearch.session import written

# Fixed values of the word rules.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SPACES = " \t\n\u000b\f\r"
NO_SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words

# A line is boilerplate of a host if this share of its different texts has it, and this many texts at least.
LINE_SHARE = 0.02
LINE_TEXTS = 10
LINE_MOST = 200  # different texts that are enough on any host, however large
MIN_LEFT = 0.3  # share of the characters that must be left


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def worded_lines(text: Column) -> Column:
    """Lines with at least one word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def normal_line(line: Column) -> Column:
    """Lower case, no white space around, numbers alike."""
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(SPACES))), "[0-9]+", "0")


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur twice: each counts up to the start of the next such window."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(rows: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(rows, i)["h"] == F.get(rows, j)["h"], F.lit(False))
        found = F.filter(rows, lambda row, i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(found, lambda row: row["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda start, i: F.least(F.coalesce(F.get(at, i + 1) - start, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    # an array of one value holds what is used more than once
    return once(once(ordered, starts), covered)


def word_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``base_failed``.

    A null text counts as without words and fails for having too few.
    """
    text = text_of(text_col)
    hashed = lambda words: F.struct(F.transform(words, lambda w: F.xxhash64(w)).alias("h"), F.length(F.array_join(words, "")).cast("long").alias("n"))
    first = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in RULES],
        once(words_of(text), hashed).alias("_words"),
        F.length(F.regexp_replace(text, NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        once(worded_lines(text), lambda found: (F.size(found) - F.size(F.array_distinct(found))).cast("long")).alias("n_dup_lines"),
    )
    count = F.size("_words.h")
    window = lambda i: F.xxhash64(F.slice("_words.h", i, F.lit(WINDOW)))
    windows = F.when(count > WINDOW, F.transform(F.sequence(F.lit(1), count - WINDOW + 1), window))
    second = first.withColumn("n_words", count.cast("long")).withColumn("word_chars", F.col("_words.n")).withColumn("_windows", windows).drop("_words")
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    repeats = F.when(F.col("_windows").isNotNull() & twice, _repeated_words(F.col("_windows"))).otherwise(F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return second.withColumn("n_repeat_words", repeats).drop("_windows").withColumn("base_failed", failed)


RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def boilerplate(lines: DataFrame, share: float = LINE_SHARE, texts: int = LINE_TEXTS) -> DataFrame:
    """``(host, line)``: hashes of lines above the limit, from ``lines(host, text_hash, lines array)``.

    Equal texts of a host count once, as copies do not make a line boilerplate. Counts are
    summed per task first, so a line that every document has is a row per task.
    """
    different = lines.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    sizes = different.groupBy("host").agg(F.count("*").alias("n_texts"))
    counts = different.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").count()
    frequent = counts.where(F.col("count") >= texts).join(sizes, "host")
    return frequent.where((F.col("count") >= share * F.col("n_texts")) | (F.col("count") >= F.greatest(F.lit(texts), F.lit(LINE_MOST)))).select("host", "line")


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    share: float = LINE_SHARE,
    texts: int = LINE_TEXTS,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """``(id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed, kept)`` per row.

    ``removed`` has the hashes of the lines above the limit. A document is kept if its words do not fail
    and at least ``min_left`` of its lines' characters is left. Null and empty texts fail for having too
    few words. A null host is a host of its own. Rows are matched with their lines by id and
    text, so repeated rows get equal results and null ids get theirs. Texts are read once.
    """
    text = text_of(text_col)
    line_of = lambda line: F.struct(F.xxhash64(normal_line(line)).alias("line"), F.length(line).alias("n"))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    lined = own.select("*", F.xxhash64("text").alias("text_hash"), F.transform(worded_lines(F.col("text")), line_of).alias("detail"))
    base = written(word_rules(lined).drop("text"), "rules")
    common = boilerplate(base.select("host", "text_hash", F.col("detail.line").alias("lines")), share, texts)
    each = base.select("id", "text_hash", "host", F.explode(F.array_distinct("detail.line")).alias("line"))
    lost = each.join(common, ["host", "line"], "left_semi").groupBy("id", "text_hash").agg(F.collect_set("line").alias("removed"))
    lost = lost.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "removed")
    same = base["id"].eqNullSafe(lost["_id"]) & (base["text_hash"] == lost["_hash"])
    length = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, d: n + d["n"])
    left = F.filter("detail", lambda d: ~F.array_contains("removed", d["line"]))
    depleted = F.col("removed").isNotNull() & (length(left) < min_left * length(F.col("detail")))
    return base.join(lost, same, "left").select(
        F.col("id").alias(id_col), "text_hash", *RULES, "removed", (~F.col("base_failed") & ~depleted).alias("kept")
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns and without their boilerplate lines.

    Null and empty texts do not pass. Repeated rows pass or fail together and stay as many as they were; null
    ids are matched by their text. An empty table gives no rows; columns of any name stay as they are.
    """
    kept = judged(docs.select(id_col, host_col, text_col), id_col, host_col, text_col).where("kept")
    kept = kept.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.first("removed").alias("_removed"))
    own = docs.withColumn("_text_hash", F.xxhash64(text_of(text_col)))
    held = own.join(kept, own[id_col].eqNullSafe(kept["_id"]) & (own["_text_hash"] == kept["_hash"]))
    stays = lambda line: ~line.rlike(WORD) | ~F.array_contains("_removed", F.xxhash64(normal_line(line)))
    text = F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(F.split(text_col, "\n"), stays), "\n"))
    return held.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
