"""Lexical search: every item's ranking against scores of all documents."""

import random
import re
from math import floor, log

import pytest

from finsearch.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(term):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)


def plain_ranking(items, docs, k):
    terms = {i: [fold(t) for t in TERM.findall(text or "")] for i, (_, text) in enumerate(docs)}
    held = {i: t for i, t in terms.items() if t}
    n_docs, length = len(held), sum(map(len, held.values()))
    df = {}
    for t in held.values():
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item_id, text in items:
        scored = []
        for i, own in held.items():
            m = 75 + 25 * len(own) * n_docs // length
            score = 0
            for term in (fold(t) for t in TERM.findall(text or "")):
                if term in own:
                    w = floor(1000 * log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    tf = own.count(term)
                    score += w * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, docs[i][0] is None, docs[i][0] or 0))
        out += [(item_id, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, items, docs, k=20):
    frame = lexical.search(
        spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, score int, rank string").repartition(3), k
    )
    assert [(f.name, f.dataType.simpleString()) for f in frame.schema.fields] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, frame.collect()), key=repr)


def test_terms():
    text = "Éa B-c_d9 \x00x\x7fŸ√[z] ß"
    assert [t.decode() for t in lexical.terms_of(text)] == [fold(t) for t in TERM.findall(text)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpus_with_many_ties(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical, "TREE_DOCS", 40)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)  # several blocks
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(rng.choice(words[: rng.choice((5, 20, 60))]) for _ in range(n))
    docs = [(i, pick(rng.choice((1, 4, 30, 200)))) for i in range(250)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # exact copies: equal scores by ascending id
    docs += [(None, "w1 w2"), (None, "w1 w2"), (7, "w1 w2"), (2000, None), (2001, ""), (2002, "... --")]
    items = [(i, pick(rng.choice((1, 3, 12)))) for i in range(15)] + [(15, docs[3][1]), (15, docs[3][1]), (16, None), (17, "unseen"), (None, "W1 w1 W2")]
    assert found(spark, items, [(*d, None, None) for d in docs], 20) == plain_ranking(items, docs, 20)


def test_long_and_empty(spark):
    docs = [(1, "tale " * 40_000 + "end"), (2, "x" * 300_000 + " end"), (3, "end")]
    items = [(1, "end tale " * 500), (2, "x" * 300_000)]
    assert found(spark, items, [(*d, None, None) for d in docs]) == plain_ranking(items, docs, 20)
    assert found(spark, items, []) == [] and found(spark, [], [(1, "a", None, None)]) == []
    assert found(spark, [(1, "b")], [(1, None, None, None)]) == []


def test_trees_skip_what_cannot_reach_the_best(spark):
    rng = random.Random(4)
    vocabulary = 200
    vectors = []
    for i in range(1500):
        own = sorted(rng.sample(range(vocabulary), 6))
        vectors.append((lexical.np.array(own), lexical.np.ones(6, lexical.np.int64), 100))
    best = lexical.BestDocuments([lexical.Counter({5: 1, 60: 1, 110: 1})], [1000 + i for i in range(vocabulary)], 5)
    met = [0]
    scores = best.scores
    best.scores = lambda *a: met.__setitem__(0, met[0] + 1) or scores(*a)
    best.search(lexical.DocumentTree(vectors), list(range(1500)))
    best.cut(0)
    weights = {t: 1000 + t for t in (5, 60, 110)}
    each = [(-sum(weights.get(int(t), 0) * int(lexical.value(lexical.np.int64(1), 100)) for t in v[0]), False, i) for i, v in enumerate(vectors)]
    assert best.found[0] == sorted(each)[:5]
    assert met[0] < 1000
