"""Ranked lexical search: every item's best documents, found in document FP-trees by branch and bound.

The documents of a task are restricted to the terms of the asked items and written as term vectors
in order of frequency, the rarest term first. Vectors that begin alike share a path of a trie. Each
node holds the largest tf of every term and the least m below it. The score grows with tf and falls
with m, so a node's maxima bound the score of each document below. A depth-first walk descends for
those items only whose bound reaches their k-th score so far.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsearch.llm.common import ranked, text_of

BLOCK_ITEMS = 256  # items that are asked in one pass over the documents
TREE_DOCS = 2048  # documents of one tree
LEAF_DOCS = 8  # a node of so few documents is not divided
SHARDS = 256  # of the candidates of one item, before they meet
# letters and digits of ASCII and all bytes beyond it belong to terms; A-Z are lower-cased
FOLD = bytes(c if c > 127 or chr(c).isalnum() and not chr(c).isupper() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in their order, as UTF-8: maximal runs of ASCII letters, digits and other scripts' characters."""
    return text.encode().translate(FOLD).split()


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def restricted(text: str, known) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms of a text, and numbers and tf of those that ``known`` numbers, in order of their numbers."""
    found = terms_of(text)
    numbers, tf = np.unique(np.array([t for t in map(known, found) if t is not None], np.int64), return_counts=True)
    return len(found), numbers, tf.astype(np.int64)


def corpus_counts(docs: DataFrame, terms: list[bytes], text_col: str = "text") -> tuple[int, int, list[int]]:
    """Documents with a term, their terms with repeats, and the df of each of the given terms, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(terms)}.get
        counts = np.zeros(len(terms) + 2, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, numbers, _ = restricted(text, known)
                counts[numbers] += 1
                counts[-2:] += (n > 0, n)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts)], names=["term", "n"])

    sums = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = {r["term"]: r["n"] for r in sums.collect()}  # a row per asked term
    counts = [held.get(i, 0) for i in range(len(terms) + 2)]
    return counts[-2], counts[-1], counts[:-2]


class DocumentTree:
    """Term vectors as a trie, packed: node -> (children, documents, terms, values of the maxima).

    Documents lie in the order of their vectors, so a node is a range of them, and the depth of the
    node is what its first and last document share. The vector of a document has the terms' numbers in
    ascending order; ``value`` turns tf and m into what a term of weight one adds to the score.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray, int]]):
        keys = [v[0].astype(">u4").tobytes() for v in vectors]
        self.order = sorted(range(len(vectors)), key=keys.__getitem__)
        keys = [keys[i] for i in self.order]
        self.vectors = [vectors[i] for i in self.order]
        self.nodes: list[tuple[list[int], range, np.ndarray, np.ndarray]] = []
        made: list[tuple[range, list[int]]] = []
        open_ranges = [(range(len(keys)), -1)]
        while open_ranges:
            docs, parent = open_ranges.pop()
            made.append((docs, []))
            if parent >= 0:
                made[parent][1].append(len(made) - 1)
            first, last = keys[docs[0]], keys[docs[-1]]
            if len(docs) <= LEAF_DOCS or first == last:
                continue
            shared = next((i for i in range(0, min(len(first), len(last)), 4) if first[i : i + 4] != last[i : i + 4]), min(len(first), len(last)))
            cuts = [docs.start, *[i for i in docs[1:] if keys[i][shared : shared + 4] != keys[i - 1][shared : shared + 4]], docs.stop]
            open_ranges += [(range(a, b), len(made) - 1) for a, b in zip(cuts, cuts[1:])]
        held: list = [None] * len(made)
        for i in range(len(made) - 1, -1, -1):  # children come after their parent
            docs, children = made[i]
            below = [held[c] for c in children] if children else [self.vectors[d] for d in docs]
            terms, tf = np.concatenate([b[0] for b in below]), np.concatenate([b[1] for b in below])
            by_term = np.argsort(terms, kind="stable")
            terms, tf = terms[by_term], tf[by_term]
            starts = np.flatnonzero(np.diff(terms, prepend=-1))
            held[i] = (terms[starts], np.maximum.reduceat(tf, starts) if len(starts) else tf, min(b[2] for b in below))
        for (docs, children), (terms, tf, m) in zip(made, held):
            self.nodes.append((children, docs, terms, value(tf, m)))


def value(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class BestDocuments:
    """The k best documents of each item so far: highest score first, then smallest id, null ids last."""

    def __init__(self, items: list[Counter], weights: list[int], k: int):
        sizes = [len(i) for i in items]
        self.starts = np.cumsum([0, *sizes[:-1]])
        self.terms = np.array([t for i in items for t in i], np.int64)
        self.weights = np.array([n * weights[t] for i in items for t, n in i.items()], np.int64)
        self.scratch = np.zeros(len(weights), np.int64)
        self.k, self.floor = k, np.ones(len(items), np.int64)
        self.found: list[list[tuple]] = [[] for _ in items]

    def scores(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For every item, the sum over its terms of weight and value."""
        self.scratch[terms] = values
        out = np.add.reduceat(self.scratch[self.terms] * self.weights, self.starts)
        self.scratch[terms] = 0
        return out

    def cut(self, item: int) -> None:
        best = self.found[item] = nsmallest(self.k, self.found[item])
        if len(best) == self.k:
            self.floor[item] = -best[-1][0]

    def search(self, tree: DocumentTree, ids: list) -> None:
        """Meet the documents of a tree; equal scores count as reached, so that the smaller id wins."""
        stack = [(0, np.full(len(self.floor), np.iinfo(np.int64).max))]
        while stack:
            node, bound = stack.pop()
            asked = bound >= self.floor
            if not asked.any():
                continue
            children, docs, _, _ = tree.nodes[node]
            if children:
                ahead = []
                for child in children:
                    limit = np.where(asked, self.scores(*tree.nodes[child][2:]), 0)
                    if (limit >= self.floor).any():
                        ahead.append((child, limit))
                stack += sorted(ahead, key=lambda x: int(x[1].max()))  # the most promising subtree is met first
                continue
            for place in docs:
                terms, tf, m = tree.vectors[place]
                scores = self.scores(terms, value(tf, m))
                for item in np.flatnonzero(asked & (scores >= self.floor)).tolist():
                    key = ids[tree.order[place]]
                    self.found[item].append((-int(scores[item]), key is None, key if key is not None else 0))
                    if len(self.found[item]) >= 4 * self.k:
                        self.cut(item)


def _candidates(docs: DataFrame, items: list[Counter], weights: list[int], known: dict[bytes, int], documents: int, length: int, k: int) -> DataFrame:
    """The k best documents of every task for each item, ``(item, doc, score)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestDocuments(items, weights, k)
        kind, asked = None, known.get
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kind = batch.schema.field(0).type
            for at in range(0, len(texts), TREE_DOCS):
                vectors, keys = [], []
                for key, text in zip(ids[at : at + TREE_DOCS], texts[at : at + TREE_DOCS]):
                    n, numbers, tf = restricted(text, asked)
                    if len(numbers):
                        vectors.append((numbers, tf, 100 - 25 + 25 * n * documents // length))
                        keys.append(key)
                if vectors:
                    best.search(DocumentTree(vectors), keys)
        if kind is None:
            return
        for item in range(len(items)):
            best.cut(item)
        rows = [(item, None if none else key, -score) for item, held in enumerate(best.found) for score, none, key in held]
        item_col, doc_col, score_col = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item_col, pa.int32()), pa.array(doc_col, kind), pa.array(score_col, pa.int64())], names=["item", "doc", "score"])

    return docs.mapInArrow(run, f"item int, doc {docs.schema[0].dataType.simpleString()}, score long")


def _cut(rows: DataFrame, k: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    items: DataFrame, docs: DataFrame, k: int = 20, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every item's ``k`` best documents, ``(item, rank, doc, score)``, ranked from 1 by score and then ascending id.

    Items, as documents, have a text column; null texts have no terms. An item without a term that any
    document holds has no rows, nor have documents with score 0. Repeated items, and repeated documents,
    are ranked each; null ids come last among equal scores. Texts are read whole, whatever their
    length. Empty tables give no rows; further columns are ignored. Items are met in blocks of
    ``BLOCK_ITEMS``, of which the distinct terms, their df and each task's k best come together.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    asked, total = ranked(items.select(F.col(item_col).alias("id"), text_of(text_col).alias("text")), [F.col("id"), F.col("text")], "items")
    found = []
    for first in range(0, total, BLOCK_ITEMS):
        rows = asked.where((F.col("rank") >= first) & (F.col("rank") < first + BLOCK_ITEMS)).orderBy("rank").collect()
        counts = [(r["rank"], Counter(terms_of(r["text"]))) for r in rows]
        terms = sorted({t for _, c in counts for t in c})
        documents, length, df = corpus_counts(texts, terms, "text")
        held = sorted((n, t) for t, n in zip(terms, df) if n)  # the rarest term is number 0
        known = {t: i for i, (_, t) in enumerate(held)}
        numbered = [(rank, Counter({known[t]: n for t, n in c.items() if t in known})) for rank, c in counts]
        numbered = [(rank, c) for rank, c in numbered if c]
        if not numbered:
            continue
        best = _candidates(texts, [c for _, c in numbered], [weight(documents, n) for n, _ in held], known, documents, length, k)
        best = _cut(best.withColumn("shard", F.spark_partition_id() % SHARDS), k, "item", "shard").drop("rank")
        names = spark.createDataFrame([(i, rank) for i, (rank, _) in enumerate(numbered)], "item int, row long")
        found.append(_cut(best, k, "item").join(F.broadcast(names), "item").select("row", "rank", "doc", "score"))
    if not found:
        found = [spark.createDataFrame([], "row long, rank int").withColumn("doc", F.lit(None).cast(texts.schema[0].dataType)).withColumn("score", F.lit(None).cast("long"))]
    ranks = found[0]
    for more in found[1:]:
        ranks = ranks.unionByName(more)
    ids = asked.select(F.col("rank").alias("row"), F.col("id").alias(item_col))
    return ranks.join(ids, "row").select(item_col, "rank", F.col("doc").alias(id_col), "score")
