"""Text index in segments: appended, deleted from and merged without building it anew.

A folder holds saved indexes of some documents each, lists of deleted documents (tombstones) and numbered
manifests that name those in use. Terms are counted over living documents only, so every score equals that of
an index that is built from the living documents at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsearch.functions.text import STOPWORDS
from finsearch.operators.ranking import small_side
from finsearch.operators.text_index import BUCKETS, TextIndex, build_text_index, load_text_index, save_text_index
from finsearch.sources.snapshots import claim_part, newest_parts

MANIFEST = "kind string, number int, folder string, n_docs long, n_terms long, stopwords array<string>, stem boolean, buckets int, positions boolean"
SEGMENT, TOMBSTONES = "segment", "tombstones"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class SegmentedIndex:
    """An index below ``path``. ``create`` starts one, ``append``, ``delete`` and ``merge`` change it, ``open`` searches it.

    Each change writes its data first and a manifest last, whose success marker makes it count: one that fails
    leaves the index as it was. One writer at a time; a writer that another one overtook fails and may be run again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, stopwords: Sequence[str] = tuple(STOPWORDS), stem: bool = False, buckets: int = BUCKETS, positions: bool = False
    ) -> SegmentedIndex:
        index = cls(spark, path)
        if index._version() is not None:
            raise FileExistsError(path)
        settings = ("settings", 0, "", 0, 0, list(stopwords), stem, buckets, positions)
        index._commit(None, [settings])
        return index

    # --- manifests -------------------------------------------------------------------------------

    def _version(self) -> int | None:
        return next(newest_parts(self.spark, self.path, "v"), None)

    def _rows(self, version: int) -> list[tuple]:
        """One row per segment and list of tombstones: merging bounds their number."""
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/v={version}").collect()]

    def _commit(self, base: int | None, rows: list[tuple], number: int | None = None) -> None:
        number = claim_part(self.spark, self.path, "v") if number is None else number
        if self._version() != base:
            raise RuntimeError(f"the index below {self.path} was changed meanwhile")
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v={number}")

    def _state(self) -> tuple[int, tuple, list[tuple], list[tuple]]:
        version = self._version()
        if version is None:
            raise FileNotFoundError(f"no index below {self.path}")
        rows = self._rows(version)
        kinds = {kind: sorted(r for r in rows if r[0] == kind) for kind in ("settings", SEGMENT, TOMBSTONES)}
        return version, kinds["settings"][0], kinds[SEGMENT], kinds[TOMBSTONES]

    # --- what is stored --------------------------------------------------------------------------

    def _read(self, rows: list[tuple], name: str, schema: str, segments: list[tuple]) -> DataFrame:
        """A table of some tombstones, of the given segments only: a merged segment leaves its tombstones behind."""
        if not rows:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(schema).parquet(*[f"{r[2]}/{name}" for r in rows])
        return stored.where(F.col("segment").isin([s[1] for s in segments]))

    def _dead(self, segments: list[tuple], tombstones: list[tuple]) -> tuple[DataFrame, int]:
        """Deleted documents by segment, and how many rows there are at most."""
        kind = self.spark.read.parquet(f"{segments[0][2]}/ids").schema["id"].dataType.simpleString() if segments else "long"
        return self._read(tombstones, "ids", f"segment int, id {kind}", segments), sum(r[3] for r in tombstones)

    def _living(self, segments: list[tuple], tombstones: list[tuple], frame) -> DataFrame:
        """Rows of all segments with their number, without those of deleted documents."""
        rows = _union([frame(s).withColumn("segment", F.lit(s[1])) for s in segments])
        dead, bound = self._dead(segments, tombstones)
        return rows.join(small_side(dead, bound), ["segment", "id"], "left_anti") if bound else rows

    def ids(self) -> DataFrame:
        """Living documents: ``(segment, id)``."""
        _, _, segments, tombstones = self._state()
        if not segments:
            return self.spark.createDataFrame([], "segment int, id long")
        return self._living(segments, tombstones, lambda s: self.spark.read.parquet(f"{s[2]}/ids")).select("segment", "id")

    def _postings(self, settings: tuple, segments: list[tuple], tombstones: list[tuple]) -> DataFrame:
        stored = lambda s: load_text_index(self.spark, s[2], settings[5], settings[6], settings[7]).postings
        return self._living(segments, tombstones, stored)

    def open(self) -> TextIndex:
        """All segments as one index, for every function that searches one.

        Frequencies of terms are those of the segments less those of deleted documents, which ``delete`` counted.
        A filter on terms reaches the files of all of them.
        """
        _, settings, segments, tombstones = self._state()
        stop, stem, buckets = tuple(settings[5]), settings[6], settings[7]
        if not segments:
            none = self.spark.createDataFrame([], "id long, text string")
            return build_text_index(none, "id", "text", stop, stem, buckets, settings[8])
        counts = [self.spark.read.parquet(f"{s[2]}/vocabulary") for s in segments]
        gone = self._read(tombstones, "vocabulary", "segment int, term string, df long, occurrences long", segments)
        counts.append(gone.select("term", (-F.col("df")).alias("df"), (-F.col("occurrences")).alias("occurrences")))
        vocabulary = _union(counts).groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences")).where("df > 0")
        n_docs = sum(s[3] for s in segments) - (self._dead(segments, tombstones)[0].count() if tombstones else 0)
        n_terms = sum(s[4] for s in segments) - (gone.agg(F.sum("occurrences")).first()[0] or 0 if tombstones else 0)
        stats = self.spark.createDataFrame([(n_docs, n_terms / n_docs if n_docs else None)], "n_docs long, avg_len double")
        return TextIndex(self._postings(settings, segments, tombstones).drop("segment"), vocabulary, stats, stop, stem, buckets)

    # --- changes ---------------------------------------------------------------------------------

    def _segment(self, index: TextIndex, ids: DataFrame, number: int) -> tuple:
        folder = f"{self.path}/segments/{number}"
        ids.select("id").write.mode("overwrite").parquet(f"{folder}/ids")
        saved = save_text_index(index, folder)
        n_docs = self.spark.read.parquet(f"{folder}/ids").count()  # from the footers
        n_terms = saved.vocabulary.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
        return (SEGMENT, number, folder, n_docs, n_terms, None, None, None, None)

    def _tombstones(self, settings: tuple, segments: list[tuple], tombstones: list[tuple], keys: DataFrame, number: int) -> tuple | None:
        """Write which living documents the keys name, and what their postings count by term."""
        folder = f"{self.path}/tombstones/{number}"
        living = self._living(segments, tombstones, lambda s: self.spark.read.parquet(f"{s[2]}/ids"))
        living.join(keys.select("id").distinct(), "id", "left_semi").select("segment", "id").write.mode("overwrite").parquet(f"{folder}/ids")
        dead = self.spark.read.parquet(f"{folder}/ids")
        n_dead = dead.count()
        if not n_dead:
            return None
        stored = lambda s: load_text_index(self.spark, s[2], settings[5], settings[6], settings[7]).postings.withColumn("segment", F.lit(s[1]))
        hit = _union([stored(s) for s in segments]).join(small_side(dead, n_dead), ["segment", "id"], "left_semi")
        counts = hit.groupBy("segment", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
        counts.write.mode("overwrite").parquet(f"{folder}/vocabulary")
        return (TOMBSTONES, number, folder, n_dead, 0, None, None, None, None)

    def append(self, df: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        """Add documents; one whose id is known replaces the one that was there. Ids must not repeat within one append."""
        version, settings, segments, tombstones = self._state()
        number = claim_part(self.spark, self.path, "v")
        index = build_text_index(df, id_col, text_col, settings[5], settings[6], settings[7], settings[8])
        added = self._segment(index, df.select(F.col(id_col).alias("id")), number)
        replaced = self._tombstones(settings, segments, tombstones, self.spark.read.parquet(f"{added[2]}/ids"), number) if segments else None
        rows = [settings, *segments, added, *tombstones, *([replaced] if replaced else [])]
        self._commit(version, rows, number)

    def delete(self, keys: DataFrame, on: str = "id") -> None:
        """Take the documents of these keys out; unknown and repeated keys do nothing."""
        version, settings, segments, tombstones = self._state()
        number = claim_part(self.spark, self.path, "v")
        gone = self._tombstones(settings, segments, tombstones, keys.select(F.col(on).alias("id")), number) if segments else None
        if gone:
            self._commit(version, [settings, *segments, *tombstones, gone], number)

    def merge(self, most: int = 8) -> bool:
        """Bring the number of segments down to ``most``: the smallest ones become one, without their deleted documents.

        A document is rewritten only when its segment is among the smallest, so large segments stay as they are. Tombstones of
        the segments that stay are gathered into one list. True if there was something to do.
        """
        version, settings, segments, tombstones = self._state()
        if len(segments) <= most and len(tombstones) <= most:
            return False
        number = claim_part(self.spark, self.path, "v")
        by_size = sorted(segments, key=lambda s: (s[3], s[1]))
        small = by_size[: len(segments) - most + 1] if len(segments) > most else []
        stay = [s for s in segments if s not in small]
        if small:
            ids = self._living(small, tombstones, lambda s: self.spark.read.parquet(f"{s[2]}/ids")).select("id")
            postings = self._postings(settings, small, tombstones).drop("segment")
            n_docs = ids.agg(F.count("*").alias("n_docs"))
            one = TextIndex(postings, postings, n_docs, tuple(settings[5]), settings[6], settings[7])
            stay.append(self._segment(one, ids, number))
        kept = []
        old = [s for s in segments if s not in small]
        dead, bound = self._dead(old, tombstones)
        if old and bound:
            folder = f"{self.path}/tombstones/{number}"
            dead.write.mode("overwrite").parquet(f"{folder}/ids")
            n_dead = self.spark.read.parquet(f"{folder}/ids").count()
            gone = self._read(tombstones, "vocabulary", "segment int, term string, df long, occurrences long", old)
            sums = gone.groupBy("segment", "term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))
            sums.write.mode("overwrite").parquet(f"{folder}/vocabulary")
            if n_dead:
                kept.append((TOMBSTONES, number, folder, n_dead, 0, None, None, None, None))
        self._commit(version, [settings, *stay, *kept], number)
        return True
