"""Text index: postings with positions, vocabulary and corpus statistics."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsearch.functions.stemming import stem_words
from finsearch.functions.text import STOPWORDS, is_indexed, words

BUCKETS = 64


@dataclass(frozen=True)
class TextIndex:
    """``postings(bucket, term, id, tf, first_pos, doc_len[, positions])``, ``vocabulary(term, df, occurrences)``
    and one row of ``stats(n_docs, avg_len)``, with the settings queries must share. Postings that are not stored
    yet are dealt by id to ``shards`` partitions."""

    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    stopwords: tuple[str, ...]
    stem: bool
    buckets: int
    shards: int | None = None

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def build_text_index(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    stopwords: Sequence[str] = tuple(STOPWORDS),
    stem: bool = False,
    buckets: int = BUCKETS,
    positions: bool = False,
) -> TextIndex:
    """Describe the index of one text column; ``save_text_index`` materializes it.

    Texts are dealt by id first, and words are counted per (term, id) where the text then lies: one shuffle of the
    texts, which are smaller than their postings, and none of words, here or in ``save_text_index``; postings move if they are stemmed.
    The outer explode keeps Spark from cutting the texts a second time for the filter it infers otherwise.
    """
    stop = tuple(stopwords)
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(shards, "id")
    docs = texts.select("id", words(F.col("text")).alias("words")).withColumn(
        "doc_len", F.coalesce(F.size(F.filter("words", lambda w: is_indexed(w, stop))), F.lit(0))
    )
    tokens = docs.select("id", "doc_len", F.posexplode_outer("words").alias("pos", "term")).where(
        is_indexed(F.col("term"), stop)
    )
    measures = [F.count("*").alias("tf"), F.min("pos").alias("first_pos"), F.min("doc_len").alias("doc_len")]
    if positions:
        measures.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    postings = tokens.groupBy("term", "id").agg(*measures)
    if stem:  # postings are stemmed, not words, and those that fall together are added
        again = [F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos"), F.min("doc_len").alias("doc_len")]
        if positions:
            again.append(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        # Python tasks lose how rows are dealt, so they are dealt by id again
        postings = postings.withColumn("term", stem_words(F.col("term"))).repartition(shards, "id").groupBy("term", "id").agg(*again)
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    index = TextIndex(postings, _vocabulary(postings), stats, stop, stem, buckets, shards)
    return replace(index, postings=postings.withColumn("bucket", index.bucket(F.col("term"))))


def _vocabulary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def save_text_index(index: TextIndex, path: str, shards: int | None = None) -> TextIndex:
    """Write the index: one folder per term bucket, in each of them one file per shard of documents, sorted by term.

    All postings of a document lie in one shard, so a search matches, scores and cuts inside the shards
    and moves its best rows only; a frequent term fills all shards evenly. Without ``shards`` there are as
    many as shuffle partitions.
    """
    spark = index.postings.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = index.postings if shards == index.shards else index.postings.repartition(shards, "id")
    (
        postings.write.partitionBy("bucket")
        .bucketBy(shards, "id")
        .sortBy("term", "id")
        .format("parquet")
        .option("path", f"{path}/postings")
        .saveAsTable(_fresh_name())
    )
    _vocabulary(spark.read.parquet(f"{path}/postings")).write.parquet(f"{path}/vocabulary")
    # the mean length follows from the vocabulary; counting the texts does not read them
    n_docs = index.stats.select("n_docs").scalar()
    total = spark.read.parquet(f"{path}/vocabulary").agg(F.sum("occurrences").alias("total"))
    stats = total.select(n_docs.alias("n_docs"), (F.coalesce("total", F.lit(0)) / n_docs).alias("avg_len"), F.lit(shards).alias("shards"))
    stats.write.parquet(f"{path}/stats")
    return load_text_index(spark, path, index.stopwords, index.stem, index.buckets)


def _fresh_name() -> str:
    return f"finsearch_postings_{uuid.uuid4().hex[:12]}"


def _sharded(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """Stored postings as a table that knows its shards: an external one, whose name is new in every session."""
    name = _fresh_name()
    columns = spark.read.parquet(path).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    spark.sql(
        f"CREATE TABLE {name} ({fields}) USING parquet PARTITIONED BY (bucket) "
        f"CLUSTERED BY (id) SORTED BY (term, id) INTO {shards} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def load_text_index(
    spark: SparkSession,
    path: str,
    stopwords: Sequence[str] = tuple(STOPWORDS),
    stem: bool = False,
    buckets: int = BUCKETS,
) -> TextIndex:
    """Open a saved index; the settings must be those it was built with."""
    stats = spark.read.parquet(f"{path}/stats")
    return TextIndex(
        postings=_sharded(spark, f"{path}/postings", stats.first()["shards"]),
        vocabulary=spark.read.parquet(f"{path}/vocabulary"),
        stats=stats,
        stopwords=tuple(stopwords),
        stem=stem,
        buckets=buckets,
    )
