"""Alignment of two tokenizers: the operator against plain code over the same libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from finsearch.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def ends(self, text):
        """Ids and byte ends of both sides, or None."""
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        a_bytes = [bytes(self.letter[c] for c in self.a.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return None
        return (a, np.cumsum([len(x) for x in a_bytes]).tolist()), (b, np.cumsum([len(x) for x in b_bytes]).tolist())

    def __call__(self, texts):
        found = [self.ends(t) for t in texts]
        links, counts = [], Counter()
        for f in found:
            own = []
            if f:
                (a, ae), (b, be) = f
                i = j = 0
                while i < len(a):
                    own.append((a[i], b[j]))
                    step_a, step_b = ae[i] <= be[j], be[j] <= ae[i]
                    i, j = i + step_a, j + step_b
            links.append(own)
            counts.update(set(own))
        most = defaultdict(int)
        for (a, _), n in counts.items():
            most[a] = max(most[a], n)
        out = []
        for f, own in zip(found, links):
            if not f:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            (a, ae), (b, be) = f
            ends = sorted(set(ae) & set(be))
            group = lambda ids, at, lo, hi: ",".join(str(x) for x, e in zip(ids, at) if lo < e <= hi)
            text = ";".join(f"{group(a, ae, lo, hi)}|{group(b, be, lo, hi)}" for lo, hi in zip([0, *ends], ends))
            best = sum(counts[p] == most[p[0]] for p in own)
            out.append((len(a), len(b), len(ends), len(own), best, sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest()))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\n  b", "tab\tx\t y", "▁", "a ▁b", "a▁ b", "<s> </s> <unk>", "<|endoftext|>", "<0x41> <0x0A>",
    "naïve façade", "日本語 テキスト", "👩‍👩‍👧 ok 👍🏽", "\x00\x01 \x7f", "é ö", "ﬁn ①", " x  y", "it's we'll '", "12345 67,890.12", "A" * 300, "x" * 5000 + " y", "　 全", "end \n\n", "\n\n  start",
    "a\x1c b", "a\x85 b", "a᠎ b", "word " * 400, "﻿bom",
]


def run(spark, texts, parts=3):
    rows = spark.createDataFrame([(i, t, None, "mine") for i, t in enumerate(texts)], "doc_id long, text string, row string, radix string").repartition(parts)
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.aligned(rows, A, B).collect()}
    assert len(found) == len(texts)
    return [found[i] for i in range(len(texts))]


def test_odd_texts(spark, plain):
    assert run(spark, ODD) == plain(ODD)


def test_random_texts_in_many_runs(spark, plain, monkeypatch):
    rng = random.Random(5)
    letters = "abcdeéñ the of 12.,'-\n\t 日本👍  "
    texts = [x[0] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choice(letters) for _ in range(rng.choice((3, 30, 300)))) for _ in range(300)] + ODD * 2 + ["the same text"] * 50
    for name, value in {"RUN_LINKS": 3000, "FRAME": 16, "FANIN": 3, "SALT_BYTES": 2000, "MEMO_CHARS": 5000, "SLICE_CHARS": 4000}.items():
        monkeypatch.setattr(alignment, name, value)
    assert run(spark, texts, 5) == plain(texts)


def test_merge_sums_equal_keys():
    rng = np.random.default_rng(1)
    runs, sums = [], Counter()
    for _ in range(20):
        keys = np.unique(rng.integers(0, 900, rng.integers(1, 400)))
        counts = rng.integers(1, 9, len(keys))
        sums.update(dict(zip(keys.tolist(), counts.tolist())))
        runs.append([alignment.packed(np.diff(keys[a : a + 7], prepend=0), counts[a : a + 7]) for a in range(0, len(keys), 7)])
    keys, counts = (np.concatenate(c) for c in zip(*alignment.merged(runs)))
    assert list(zip(keys.tolist(), counts.tolist())) == sorted(sums.items())


def test_empty_and_repeated(spark, plain):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(empty, A, B).count() == 0
    rows = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, None)], "doc_id long, text string")
    found = alignment.aligned(rows, A, B)
    want = plain(["x y", "x y", None])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == sorted(want)
    assert found.where(F.col("doc_id").isNull()).count() == 2


def test_million_blanks(spark):
    found = run(spark, [" " * 1_200_000 + "x", "x"])
    assert found[0][0] > 0 and found[1][0] == 1
