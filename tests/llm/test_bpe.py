"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from finsearch.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.encoder(PATH)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert OWN.encode(text) == ids(text)
    assert OWN.decode(ids(text)) == LIBRARY.decode(ids(text), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0    　ab'sl1²é中😀<|>", max_size=40))
def test_white_space_and_contractions(text):
    assert OWN.encode(text) == ids(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_999, " " * 5000 + "x", "\n" * 3001, "0123456789" * 999, "the " * 3000, "é" * 4001, "<|endoftext|>" * 3 + "x<|endoftext|"])
def test_long_pieces_and_special_strings(text):
    assert OWN.encode(text) == ids(text)


def test_random_pieces_of_vocabulary():
    rng = random.Random(1)
    tokens = [t for t in OWN.bytes_of.values()]
    for _ in range(1500):
        text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))).decode("utf-8", "replace")
        assert OWN.encode(text) == ids(text)


def test_small_memo_gives_the_same():
    small = bpe.Encoder(PATH, memo=3)
    text = "one two three four five six seven one two three " * 5
    assert small.encode(text) == ids(text)


def test_invalid_bytes_become_replacement_characters():
    broken = [i for i, b in OWN.bytes_of.items() if b in (b"\xff", b"\xc3", b"\xe4\xb8")] + ids("a")
    assert OWN.decode(broken) == LIBRARY.decode(broken, skip_special_tokens=False)


def test_rows(spark):
    rows = [(1, "some text"), (2, None), (3, ""), (None, "null id"), (4, "twice"), (4, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(0))
    encoded = bpe.encode_texts(docs, PATH)
    got = [(r["doc_id"], r["ids"]) for r in encoded.collect()]
    assert got == [(i, ids(t or "")) for i, t in rows]
    assert [r["text"] for r in bpe.decode_ids(encoded, PATH).collect()] == [t or "" for _, t in rows]
    digests = bpe.round_trip(docs, PATH).collect()
    assert [r["n_tokens"] for r in digests] == [len(ids(t or "")) for _, t in rows]
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_bpe_round_trip"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        found = ids(docs[r["doc_id"]])
        assert r["n_tokens"] == len(found)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(found, skip_special_tokens=False).encode()).hexdigest()
