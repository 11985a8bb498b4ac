"""Packing: pieces against the tokenizers library, places against sequential best fit."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from finsearch.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    """Number of sequences of the sequential algorithm."""
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, opened = capacity, opened + 1
        insort(gaps, gap - length)
    return opened


def check_places(rows, capacity):
    """rows: (length, sequence, offset); sequences are gapless from 0 and not too long."""
    held = defaultdict(list)
    for length, sequence, offset in rows:
        held[sequence].append((offset, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def placed(counts, capacity):
    rows = []
    for length, rank, first, per, offset in (runs := sorted(packing.fit_runs(counts, capacity))):
        following = [r[1] for r in runs if r[0] == length and r[1] > rank]
        for i in range(min(following, default=counts[length]) - rank):
            rows.append((length, first + i // per, offset + i % per * length))
    return rows


def test_runs_equal_sequential_best_fit():
    rng = random.Random(2)
    for case in range(200):
        capacity = rng.choice((5, 16, 64, 1024))
        many = rng.choice((1, 7, 60, 400))
        lengths = [min(capacity, max(1, int(rng.expovariate(1 / (capacity * rng.choice((0.1, 0.3, 0.6))))))) for _ in range(many)]
        counts = Counter(lengths)
        rows = placed(counts, capacity)
        assert Counter(r[0] for r in rows) == counts, case
        assert check_places(rows, capacity) == best_fit_decreasing(lengths, capacity)


def test_no_documents():
    assert packing.fit_runs({}) == []


def test_pieces_and_places(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta <|endoftext|> épsilon 中 zeta ".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(int(rng.expovariate(1 / 150))))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (1002, "x " * 5000), (1003, "same"), (1003, "same")] + [(2000 + i, "one hot text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("mine")).withColumn("row", F.lit(1))
    got = packing.pack(docs.repartition(5), PATH).collect()
    library = Tokenizer.from_file(PATH)
    expected = Counter()
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            data = b"".join(x.to_bytes(4, "little") for x in ids[a:b])
            expected[i, piece, a, b - a, data] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == expected
    lengths = [k[3] for k, n in expected.items() for _ in range(n)]
    used = check_places([(r["length"], r["sequence_id"], r["offset"]) for r in got], 1024)
    assert used == best_fit_decreasing(lengths, 1024)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op1_best_fit_packing"](spark, folder).collect()
    used = check_places([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 1024)
    assert used == best_fit_decreasing([r["length"] for r in rows], 1024)
    library = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs)
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    for i, text in list(docs.items())[::7]:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert sum(r["length"] for r in of[i]) == len(ids)
        for r in of[i]:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))


def test_long_white_space_packs_to_the_ids_of_the_library(spark):
    own = Tokenizer.from_file(PATH)
    texts = ["a" + " " * 1_500_000 + "b", "\n" * 1_200_000, "x \t" * 30_000 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in packing.pack(docs, PATH).orderBy("doc_id", "piece").collect():
        found.setdefault(r["doc_id"], b"")
        found[r["doc_id"]] += bytes(r["ids"])
    for i, text in enumerate(texts):
        ids = own.encode(text, add_special_tokens=False).ids + [2]
        assert found[i] == b"".join(x.to_bytes(4, "little") for x in ids)
