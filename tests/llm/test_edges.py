"""Every query and the pipeline on tables with nulls in all columns, extra columns, repeated rows, long texts, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from finsearch.llm import queries

LONG = "word " * 30_000 + "x" * 60_000 + "é😀" * 5_000
CLASHES = ["text_hash", "fingerprint", "ids", "tokens", "length", "rank", "score", "lang_pred", "kept", "removed", "piece", "row", "row_id", "label", "node", "part", "place", "entities", "payload", "formatted", "html_text", "held_out", "run", "radix", "words", "asked", "doc", "item"]


def tables(spark, path, empty):
    docs = [(1, "One plain text of some words, " * 20, "en", "a", 10), (1, "One plain text of some words, " * 20, "en", "a", 10), (None, None, None, None, None)]
    docs += [(2, None, "en", None, None), (3, "", None, "a", 0), (4, LONG, "fr", "b", 1), (None, "Un texte sans numéro " * 12, "fr", None, 3), (5, " \n\t ", "de", "b", 4), (6, "!!! 123 ...", "xx", "c", 5)]
    pages = [(1, None, None), (None, "u", "<p>text</p>"), (2, "u", ""), (3, "u", "<article><p>" + LONG + "</p></article>"), (3, "u", "<article><p>" + LONG + "</p></article>"), (4, "u", "<" * 3000)]
    talks = [(1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b"), (2, 1, "assistant", LONG), (2, 1, "assistant", LONG), (3, 0, "robot", "</s>\\")]
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
        "conversations": spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"),
    }
    items = [(1, "One plain text"), (2, None), (None, "sans"), (3, "")]
    frames["benchmark"] = spark.createDataFrame(items, "item_id long, text string")
    for name, df in frames.items():
        for clash in CLASHES:
            df = df.withColumn(clash, F.lit("mine") if clash != "rank" else F.lit(None).cast("int"))
        (df.limit(0) if empty else df).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return {"op3": 6, "op5": 6, "op7": 5, "op13": 3, "docs": len(docs)}


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    return path, tables(spark, path, empty=False)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing"))
    tables(spark, path, empty=True)
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_edge_rows(spark, edges, name):
    path, rows = edges
    found = queries.QUERIES[name](spark, path).collect()
    number = name.split("_")[0]
    if number == "op1":
        assert len({r["doc_id"] for r in found}) == 7
    else:
        assert len(found) == rows.get(number, rows["docs"])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, nothing, name):
    found = queries.QUERIES[name](spark, nothing).collect()
    assert len(found) == (1 if name.startswith("op7_") else 0)  # op7 adds a conversation


def test_pipeline(spark, edges, nothing):
    kept = corpus_pipeline.run(spark, edges[0]).collect()
    assert {r["doc_id"] for r in kept} <= {1, 4, None}
    assert corpus_pipeline.run(spark, nothing).count() == 0
