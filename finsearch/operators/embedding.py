"""Text vectors that queries and documents share: hashed words with idf weights, fitted once and stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsearch.functions.text import words

SLOTS = 256


def slot_counts(held: pa.ListArray, dim: int) -> np.ndarray:
    """How often each slot occurs in each text, texts by slots, from the words of the texts.

    Words hash by the first eight hex digits of their MD5, each distinct word once.
    """
    distinct = held.flatten().dictionary_encode()
    slots = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % dim if w else -1 for w in distinct.dictionary.to_pylist()], np.int64)
    slots = slots[distinct.indices.to_numpy()] if len(slots) else slots
    rows = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy()))
    return np.bincount((rows * dim + slots)[slots >= 0], minlength=len(held) * dim).reshape(len(held), dim)


def _words(text: Column) -> Column:
    return words(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class Embedder:
    """Word slots and their idf weights, learned from one corpus.

    A text has the same vector whether it is embedded with the corpus or alone. Words that the
    corpus does not have weigh most.
    """

    dim: int
    n_docs: int
    df: tuple[int, ...]

    def idf(self) -> list[float]:
        return [log((self.n_docs + 1) / (df + 1)) for df in self.df]

    def transform(self, docs: DataFrame, text_col: str = "text", name: str = "embedding") -> DataFrame:
        """``docs`` with a unit vector of each text; texts without a weighted word have the zero vector."""
        dim, idf = self.dim, self.idf()

        @F.arrow_udf("array<double>")
        def vectors(held: pa.Array) -> pa.Array:
            out = slot_counts(held, dim) * np.array(idf)
            norms = np.sqrt(np.einsum("ij,ij->i", out, out))
            out /= np.where(norms > 0, norms, 1.0)[:, None]
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32)), pa.array(out.ravel()))

        return docs.withColumn(name, vectors(_words(F.col(text_col))))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.dim, self.n_docs, list(self.df))], "dim int, n_docs long, df array<long>").write.parquet(path)


def load_embedder(spark: SparkSession, path: str) -> Embedder:
    row = spark.read.parquet(path).first()
    return Embedder(row["dim"], row["n_docs"], tuple(row["df"]))


def fit_embedder(docs: DataFrame, text_col: str = "text", dim: int = SLOTS) -> Embedder:
    """Count in how many texts each slot occurs; ``dim`` numbers come to the driver, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, np.int64)
        for batch in batches:
            total += (slot_counts(batch.column(0), dim) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], names=["slot", "n"])

    held = docs.select(_words(F.col(text_col)).alias("words")).mapInArrow(count, "slot int, n long")
    found = {r["slot"]: r["n"] for r in held.groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    return Embedder(dim, docs.count(), tuple(found.get(i, 0) for i in range(dim)))


def embed(
    df: DataFrame,
    text_col: str = "text",
    model: str = "tfidf-hash",
    dim: int = SLOTS,
    encode: Callable[[list[str]], Sequence[Sequence[float]]] | None = None,
    embedder: Embedder | None = None,
) -> DataFrame:
    """Add ``embedding`` and ``embedding_model``.

    By default with ``embedder``, or with one fitted on ``df``. ``encode`` takes a batch of texts and
    returns one vector each; it runs inside the tasks, batch by batch.
    """
    if encode is not None:

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([list(map(float, v)) for v in encode(texts.tolist())])

        return df.withColumn("embedding", vectors(F.col(text_col))).withColumn("embedding_model", F.lit(model))
    embedder = embedder or fit_embedder(df, text_col, dim)
    return embedder.transform(df, text_col).withColumn("embedding_model", F.lit(f"{model}-{embedder.dim}"))
