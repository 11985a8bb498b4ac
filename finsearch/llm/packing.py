"""Best-fit packing of tokenized documents into sequences of bounded length.

Rounds go from the longest documents to the shortest. In a round every document of the round asks
for the successor of its length among the gaps: the smallest gap that still takes it. Documents
that ask for the same gaps are told apart by rank, the gaps shrink, and the next round follows.
Lengths and gaps are whole numbers up to the capacity, so sorted documents and sorted gaps are
held as runs of equal size: the rounds work on (size, number) and their work depends on the
capacity, not on the number of documents. The rows themselves are range-sorted once, ranked, and
meet the runs in a sweep over each range.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.llm.common import in_order, text_of, worker_memo
from finsearch.llm.subwords import ByteLevel
from finsearch.session import written

CAPACITY = 1024


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, piece, start, length, ids)``: the ids of every document, with ``end_id`` last, in pieces of at most ``capacity``.

    Only longer documents are cut: every piece is full but the first, which takes the rest. ``ids``
    holds little-endian unsigned 32-bit numbers. A null or empty text is one piece, the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_memo(("byte-level", tokenizer), lambda: ByteLevel(tokenizer, special=True))
        for batch in batches:
            keys, pieces, starts, lengths, data = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*own.encode(text), end_id], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    keys.append(i)
                    pieces.append(piece)
                    starts.append(a)
                    lengths.append(b - a)
                    data.append(ids[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keys, pa.int64())),
                    pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                names=[id_col, "piece", "start", "length", "ids"],
            )

    source = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The rounds: ``(length, first rank, first sequence, documents per sequence, first offset)`` of each run.

    ``counts`` has the number of documents of each length. A run places documents of one length,
    from one rank on, into sequences with consecutive numbers whose gaps are equal. Best fit puts
    the next document of a round into the gap just made as long as it fits, hence several
    documents per sequence.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> runs of (first sequence, number)
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        successors = [g for g in sorted(gaps) if g >= length]
        while left:
            if successors:
                gap = successors.pop(0)
                offers = gaps.pop(gap)
            else:  # no gap takes it: new sequences, as many as the rest of the round needs
                gap = capacity
                offers = [(opened, -(-left // (capacity // length)))]
                opened += offers[0][1]
            per = gap // length
            while offers and left:
                first, number = offers.pop(0)
                full = min(number, left // per)
                if full:
                    runs.append((length, rank, first, per, capacity - gap))
                    gaps[gap - per * length].append((first, full))
                    rank, left = rank + full * per, left - full * per
                if left and full < number:  # the last sequence of the round takes what is left
                    runs.append((length, rank, first + full, per, capacity - gap))
                    gaps[gap - left * length].append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < number:
                    offers.insert(0, (first + full, number - full))
            gaps[gap] += offers
        gaps.pop(0, None)
        for size in [g for g, held in gaps.items() if not held]:
            del gaps[size]
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces(keys, length)`` with ``sequence_id`` and ``offset``.

    Best-fit decreasing. Ties of length are ranked by the keys; rows equal in all keys are
    placed one after the other. Full pieces and hot lengths are ranked like all others, in even
    ranges. Only the number of rows per length and range comes to the driver.
    """
    order = [F.col("length").desc(), *[F.col(k).asc_nulls_first() for k in keys]]
    placed = in_order(pieces.select(*keys, "length"), order, "pieces-by-length")
    held = placed.groupBy("part", "length").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()
    counts: dict[int, int] = defaultdict(int)
    base: dict[tuple[int, int], int] = {}  # (part, length) -> rank of the row at place 0
    for part, length, n, first in sorted((r["part"], r["length"], r["n"], r["first"]) for r in held):
        base[part, length] = counts[length] - first
        counts[length] += n
    runs = np.array(sorted(fit_runs(dict(counts), capacity)), dtype=np.int64).reshape(-1, 5)
    bases = np.array([(p << 20 | n, b) for (p, n), b in sorted(base.items())], dtype=np.int64).reshape(-1, 2)
    names = [*keys, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = runs[:, 0] << 42 | runs[:, 1]
        for batch in batches:
            part, at, length = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("part", "place", "length"))
            rank = at + bases[np.searchsorted(bases[:, 0], part << 20 | length), 1]
            of = runs[np.searchsorted(starts, length << 42 | rank, side="right") - 1]
            within = rank - of[:, 1]
            own = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(of[:, 2] + within // of[:, 3]), pa.array(of[:, 4] + within % of[:, 3] * length)], names=names
            )

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "sequence_id long", "offset long"])
    return placed.mapInArrow(run, schema)


def with_places(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces from a written table, numbered in ``row``, with all their columns, ``sequence_id`` and ``offset``.

    Whatever the pieces carry is shuffled once, to meet the places: leave out what is not needed.
    """
    where = place(pieces.select("doc_id", "piece", "row", "length"), capacity, ("doc_id", "piece", "row"))
    return pieces.join(where.select("row", "sequence_id", "offset"), "row").drop("row")


def written_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of ``tokenized_pieces`` as a written table, numbered in ``row``; their id is ``doc_id``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return written(tokenized_pieces(source, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every piece with its ids and place: ``(id, piece, start, length, ids, sequence_id, offset)``.

    A sequence holds at most ``capacity`` ids, its pieces lie gapless from offset 0. Null and empty
    texts are packed as their end id; a null id stays null; repeated rows are packed each. An empty
    table gives no rows.
    """
    pieces = written_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    return with_places(pieces, capacity).select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids", "sequence_id", "offset"
    )
