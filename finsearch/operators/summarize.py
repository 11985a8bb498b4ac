"""Extractive summaries (after H. P. Luhn, 1958): the sentences whose words weigh most."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence
from math import fsum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from finsearch.functions.text import STOPWORDS, is_indexed, words

SENTENCE_END = r"([.!?])\s+"
MARK = "\u0001"
RUN_CHARS = 4_000_000  # characters of the texts whose words are looked up together, about


def sentences(text: Column) -> Column:
    """The sentences of a text with a sign in them, as ``array<struct<no, sentence>>``."""
    cut = F.split(F.regexp_replace(text, SENTENCE_END, "$1" + MARK), MARK)
    return F.filter(F.transform(cut, lambda s, no: F.struct(no.alias("no"), s.alias("sentence"))), lambda s: F.trim(s["sentence"]) != "")


def summarize(
    docs: DataFrame,
    text: str = "text",
    n_sentences: int = 3,
    stopwords: Sequence[str] = tuple(STOPWORDS),
    idf: DataFrame | None = None,
) -> DataFrame:
    """``(id, summary)``: the best sentences of each text in their original order.

    A sentence scores the mean tf-idf of its words, tf within its text and idf over all texts, or
    ``idf(term, idf)`` of a larger corpus when only some of its texts are summarized.
    Sentences without an indexed word score zero, so every text with a sentence has a summary.
    Texts are dealt to runs by their ids once and stay there: a run asks for its different words, gets their idf
    and scores its sentences, so neither words nor sentences are moved.
    """
    n_docs, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    runs = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // RUN_CHARS))
    dealt = docs.select(F.pmod(F.xxhash64("id"), F.lit(runs)).alias("run"), "id", F.col(text).alias("text")).repartition("run")
    cut = dealt.select("run", "id", sentences(F.col("text")).alias("sentences"))
    kept = lambda s: F.filter(words(s["sentence"]), lambda w: is_indexed(w, tuple(stopwords)))
    cut = cut.select("run", "id", F.transform("sentences", lambda s: F.struct(s["no"].alias("no"), s["sentence"].alias("sentence"), kept(s).alias("words"))).alias("sentences"))

    def count(table: pa.Table) -> pa.Table:
        held = defaultdict(set)
        for key, parts in zip(table["id"].to_pylist(), table["sentences"].to_pylist()):
            for part in parts or ():
                held[key].update(part["words"])
        n = Counter(term for own in held.values() for term in own)
        run = pa.array([table["run"][0].as_py()] * len(n), pa.int64())
        return pa.table([run, pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["run", "term", "n"])

    terms = cut.groupBy("run").applyInArrow(count, "run long, term string, n long")
    if idf is None:
        found = terms.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).select("run", "term", F.log(n_docs / F.col("df")).alias("idf"))
    else:
        found = terms.select("run", "term").join(idf, "term").select("run", "term", "idf")
    id_type = to_arrow_type(docs.schema["id"].dataType)

    def choose(texts: pa.Table, weights: pa.Table) -> pa.Table:
        idfs = dict(zip(weights["term"].to_pylist(), weights["idf"].to_pylist()))
        own = defaultdict(list)
        for key, parts in zip(texts["id"].to_pylist(), texts["sentences"].to_pylist()):
            own[key] += parts or ()
        rows = [(key, _best(parts, idfs if key is not None else {}, n_sentences)) for key, parts in own.items() if parts]
        keys, summaries = zip(*rows) if rows else ((), ())
        return pa.table([pa.array(keys, id_type), pa.array(summaries, pa.string())], names=["id", "summary"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, summary string"
    return cut.groupBy("run").cogroup(found.groupBy("run")).applyInArrow(choose, schema)


def _best(parts: list[dict], idfs: dict[str, float], n: int) -> str:
    """The n best of a text's sentences in their order; equal scores in order of place."""
    tf = Counter(w for part in parts for w in part["words"])
    by_place = defaultdict(list)
    for part in parts:
        by_place[part["no"]] += [tf[w] * idfs[w] for w in part["words"] if w in idfs]
    scores = {no: round(fsum(own) / len(own), 9) if own else 0.0 for no, own in by_place.items()}
    best = sorted(parts, key=lambda part: (-scores[part["no"]], part["no"]))[:n]
    return " ".join(sentence for _, sentence in sorted((part["no"], part["sentence"]) for part in best))
