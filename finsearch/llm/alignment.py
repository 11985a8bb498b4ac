"""Alignment of two tokenizers over a corpus, with counts of the id pairs that they link.

A task works out the tokens, groups and links of its documents and spills pair-document records:
sorted by side A, side B and document, radix-partitioned by the id of side A, in zstd runs that are
rows of a written table. A run has its pairs with their number of documents in front of the
records, so the count of every pair comes from a k-way heap merge of those heads alone, in as many
levels as the number of runs needs. The last level sees all pairs of an A id one after the other,
which gives its maximum. Counts then stream against the records, run by run, and what they add to
each document goes back to the run that it came from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.llm.common import text_of, worker_memo
from finsearch.llm.subwords import ByteLevel, Pieces
from finsearch.session import written

RADIX = 64  # parts of the ids of side A
RUN_LINKS = 1 << 22  # links of a run
FRAME = 1 << 16  # pairs of a frame
FANIN = 64  # runs that are merged at a time
SALT_BYTES = 8 << 20  # records of a part that are met by one copy of its counts
MEMO_CHARS = 4_000_000  # characters of words whose tokens a worker holds
SLICE_CHARS = 4_000_000  # characters of documents that are looked at together


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one zstd frame, byte by byte of equal weight together."""
    raw = b"".join(np.ascontiguousarray(c, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(frame: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view("<i8").reshape(-1) for c in raw]


def frames_of(keys: np.ndarray, *columns: np.ndarray) -> list[bytes]:
    """Sorted rows in frames; keys as differences."""
    cuts = range(0, len(keys), FRAME)
    return [packed(np.diff(keys[a : a + FRAME], prepend=0), *[c[a : a + FRAME] for c in columns]) for a in cuts]


def read_frame(frame: bytes, columns: int) -> list[np.ndarray]:
    steps, *others = unpacked(frame, columns)
    return [np.cumsum(steps), *others]


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their summed counts, of any number of sorted runs of frames.

    The heap tells whose frame ends first: up to that key nothing can follow from any other frame.
    """
    rest = [iter(r) for r in runs]
    heads: dict[int, list[np.ndarray]] = {}
    ends: list[tuple[int, int]] = []

    def advance(run: int) -> None:
        frame = next(rest[run], None)
        if frame is None:
            heads.pop(run, None)
        else:
            heads[run] = read_frame(frame, 2)
            ends.append((int(heads[run][0][-1]), run)) if not started else heappush(ends, (int(heads[run][0][-1]), run))

    started = False
    for run in range(len(runs)):
        advance(run)
    heapify(ends)
    started = True
    while ends:
        limit = ends[0][0]
        taken = []
        for run in list(heads):
            keys, counts = heads[run]
            cut = int(np.searchsorted(keys, limit, side="right"))
            taken.append((keys[:cut], counts[:cut]))
            heads[run] = [keys[cut:], counts[cut:]]
        while ends and ends[0][0] == limit:
            advance(heappop(ends)[1])
        keys, counts = (np.concatenate(c) for c in zip(*taken))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[starts], np.add.reduceat(counts, starts)


class Words:
    """Tokens of both tokenizers by word, each worked out once.

    Where no token of either side goes on after the end of a word, a text's tokens are those of its
    words, each with the space before it. A whole text that is not regular counts as one word.
    """

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        ids = 1 + max(max(self.a.bytes), len(self.b.bytes))
        if ids * len(self.b.bytes) >= 1 << 31:
            raise ValueError("the vocabularies are too large: a pair of ids must fit in 31 bits")
        self.a_sizes = np.zeros(ids, np.int64)
        self.a_sizes[list(self.a.bytes)] = [len(b) for b in self.a.bytes.values()]
        self.b_sizes = np.array([len(b) for b in self.b.bytes], np.int64)
        self.written = [f"{i}{mark}" for i in range(ids) for mark in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.texts: list[str] = []  # the groups of each word
        self.chars = 0
        self.numbers = np.zeros((0, 6), np.int64)  # tokens A and B, groups, links, usable, ends in white space
        self.starts, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Tokens, groups and links of words that are not known yet, all at once."""
        a_ids, b_ids, usable = [], [], []
        for word, b_own in zip(words, self.b.encode_all(words)):
            whole = f" {word}".encode()
            a_own = self.a.encode(f" {word}")
            same = b"".join(map(self.a.bytes.__getitem__, a_own)) == whole == b"".join(map(self.b.bytes.__getitem__, b_own))
            usable.append(same)
            a_ids.append(a_own if same else [])
            b_ids.append(b_own if same else [])
        a = np.fromiter(chain.from_iterable(a_ids), np.int64)
        b = np.fromiter(chain.from_iterable(b_ids), np.int64)
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.zeros(1 + (int(a_end[-1]) if len(a) else 0), np.uint8)
        ends[a_end] = 1
        ends[b_end] += 2
        cut = np.flatnonzero(ends)  # between two cuts lies one token of either side: a link
        kind = ends[cut]
        of_a, of_b = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64)
        links = a[np.cumsum(of_a) - of_a] * len(self.b_sizes) + b[np.cumsum(of_b) - of_b]
        full = cut[kind == 3]
        n_a, n_b = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
        word_end = np.concatenate([[0], a_end])[np.cumsum(n_a)]
        link_ends, group_ends = np.searchsorted(cut, word_end, side="right"), np.searchsorted(full, word_end, side="right")
        # the tokens in order of group, side and place, each with the mark that follows it
        group = np.concatenate([np.searchsorted(full, a_end), np.searchsorted(full, b_end)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(2 * group + side, kind="stable")
        place = (2 * group + side)[order]
        last = np.append(place[1:] != place[:-1], True) if len(place) else np.zeros(0, bool)
        codes = (3 * np.concatenate([a, b])[order] + np.where(last, 1 + side[order], 0)).tolist()
        token_ends = np.cumsum(n_a + n_b).tolist()
        name = self.written.__getitem__
        self.texts += ["".join(map(name, codes[i:j])) for i, j in zip([0, *token_ends], token_ends)]
        self.places.update(zip(words, range(len(self.places), len(self.places) + len(words))))
        self.chars += sum(map(len, words)) + 8 * len(words)
        blank = [not w or w[-1].isspace() for w in words]
        numbers = np.stack([n_a, n_b, np.diff(group_ends, prepend=0), np.diff(link_ends, prepend=0), np.array(usable, np.int64), np.array(blank, np.int64)], axis=1)
        self.starts = np.concatenate([self.starts, len(self.links) + np.concatenate([[0], link_ends[:-1]])]).astype(np.int64)
        self.numbers = np.concatenate([self.numbers, numbers])
        self.links = np.concatenate([self.links, links])

    def known(self, texts: list[str]) -> list[list[int]]:
        """The words of every text, as places; texts without words have none."""
        if self.chars > MEMO_CHARS:
            self.forget()
        parts = [t.split(" ") if self.b.by_word else [t] for t in texts]
        self._meet(parts)
        blank = self.numbers[:, 5].tolist()
        places = [[self.places[w] for w in own] if text else [] for own, text in zip(parts, texts)]
        odd = [i for i, own in enumerate(places) if len(own) > 1 and (any(map(blank.__getitem__, own[:-1])) or not parts[i][-1])]
        self._meet([[texts[i]] for i in odd])
        for i in odd:
            places[i] = [self.places[texts[i]]]
        return places

    def _meet(self, parts: list[list[str]]) -> None:
        new = list(dict.fromkeys(w for own in parts for w in own if w not in self.places))
        if new:
            self.learn(new)


def _records(composite: np.ndarray, first: int, size_b: int) -> Iterator[tuple]:
    """The rows of one run, ``(radix, run, heads, records)``: sorted by A, B and document within each part."""
    values, times = np.unique(composite, return_counts=True)
    keys, docs = values >> 32, values & 0xFFFFFFFF
    part = (keys // size_b % RADIX).astype(np.uint8)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(RADIX), side="right").tolist()
    for radix, (a, b) in enumerate(zip([0, *ends], ends)):
        if a < b:
            own = order[a:b]
            starts = np.flatnonzero(np.diff(keys[own], prepend=-1))
            steps = np.diff(docs[own], prepend=0)
            steps[starts] = docs[own][starts]
            yield radix, first, frames_of(keys[own][starts], np.diff(starts, append=b - a)), packed(steps, times[own])


def _spilled(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A written table of a row per document and a row per run and part; a run bears the number of its first document."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_memo(("alignment", a_path, b_path), lambda: Words(a_path, b_path))
        size_b, held, links, first, id_type = len(words.b_sizes), [], 0, 0, None

        def doc_rows(rows: np.ndarray, ids: pa.Array, numbers: np.ndarray, digests: list[str]) -> pa.RecordBatch:
            none = len(rows)
            columns = [pa.array(rows), ids, *[pa.array(numbers[:, i]) for i in range(4)], pa.array(digests, pa.string())]
            columns += [pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.binary())), pa.nulls(none, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def run_rows() -> Iterator[pa.RecordBatch]:
            for radix, at, heads, records in _records(np.concatenate(held), first, size_b):
                columns = [pa.nulls(1, pa.int64()), pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
                columns += [pa.array([radix], pa.int32()), pa.array([at], pa.int64()), pa.array([heads], pa.list_(pa.binary())), pa.array([records], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            rows, texts, id_type = batch.column(0).to_numpy(), batch.column(2).to_pylist(), batch.schema.field(1).type
            sizes = np.cumsum([len(t) for t in texts]) // SLICE_CHARS
            cuts = [0, *(1 + np.flatnonzero(np.diff(sizes))).tolist(), len(texts)] if texts else [0]
            for a, b in zip(cuts, cuts[1:]):
                places = words.known(texts[a:b])
                flat = np.fromiter(chain.from_iterable(places), np.int64)
                of = np.repeat(np.arange(b - a), [len(p) for p in places])
                good = np.bincount(of, words.numbers[flat, 4] == 0, b - a) == 0
                numbers = np.stack([np.bincount(of, words.numbers[flat, i], b - a) for i in range(4)], axis=1).astype(np.int64) * good[:, None]
                name = words.texts.__getitem__
                digests = [hashlib.sha256("".join(map(name, own))[:-1].encode()).hexdigest() if n else "" for own, n in zip(places, numbers[:, 0])]
                yield doc_rows(rows[a:b], batch.column(1).slice(a, b - a), numbers, digests)
                flat, of = flat[good[of]], of[good[of]]
                counts = words.numbers[flat, 3]
                before = np.cumsum(counts) - counts
                at = np.repeat(words.starts[flat] - before, counts) + np.arange(int(counts.sum()))
                if not held:
                    first = int(rows[a])
                held.append(words.links[at] << 32 | np.repeat(rows[a:b][of] - first, counts))
                links += len(at)
                if links >= RUN_LINKS:
                    yield from run_rows()
                    held, links = [], 0
        if links:
            yield from run_rows()

    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "radix", "run", "heads", "records"]
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, run long, heads array<binary>, records binary"
    return written(source.mapInArrow(run, schema), "aligned")


def pair_counts(runs: DataFrame, size_b: int) -> DataFrame:
    """``(radix, frames)``: sorted pairs of every part, in how many documents each is linked, and whether its A id has no more frequent one.

    ``FANIN`` runs are merged at a time, in further levels as long as more are left of a part.
    """

    def merge(last: bool):
        def run(table: pa.Table) -> pa.Table:
            parts = list(merged(table["heads"].to_pylist()))
            keys, counts = (np.concatenate(c) for c in zip(*parts))
            columns = [counts]
            if last:
                side = keys // size_b
                starts = np.flatnonzero(np.diff(side, prepend=-1))
                most = np.maximum.reduceat(counts, starts)
                columns.append((counts == np.repeat(most, np.diff(starts, append=len(keys)))).astype(np.int64))
            return pa.table([table["radix"].slice(0, 1), pa.array([frames_of(keys, *columns)], pa.list_(pa.binary()))], names=["radix", "heads"])

        return run

    left = runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    level = runs.select("radix", "heads", F.xxhash64("run").alias("deal"))
    while True:
        groups = max(1, -(-left // FANIN))
        dealt = level.select("radix", "heads", F.pmod("deal", F.lit(groups)).alias("part"))
        level = written(dealt.groupBy("radix", "part").applyInArrow(merge(groups == 1), "radix int, heads array<binary>"), "merged")
        if groups == 1:
            return level
        level, left = level.withColumn("deal", F.monotonically_increasing_id()), groups


def _contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``(run, added)``: what each part adds to the documents of a run. Counts are met in order, run by run; large parts are dealt to several copies of their counts."""
    sizes = runs.groupBy("radix").agg(F.ceil(F.sum(F.length("records")) / F.lit(SALT_BYTES)).cast("int").alias("salts"))
    sizes = F.broadcast(sizes)  # a row per part
    copies = counts.join(sizes, "radix").select("radix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-1).cast("long").alias("run"), "heads", F.lit(None).cast("binary").alias("records"))
    dealt = runs.join(sizes, "radix").select("radix", F.pmod(F.xxhash64("run"), "salts").cast("int").alias("salt"), "run", "heads", "records")
    met = copies.unionByName(dealt).repartition("radix", "salt").sortWithinPartitions("radix", "salt", "run")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                run, heads = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if run < 0:
                    keys, counts, best = (np.concatenate(c) for c in zip(*[read_frame(f, 3) for f in heads]))
                    continue
                own, n = (np.concatenate(c) for c in zip(*[read_frame(f, 2) for f in heads]))
                steps, times = unpacked(batch.column(4)[i].as_py(), 2)
                place = np.repeat(np.searchsorted(keys, own), n)
                docs = np.cumsum(steps)
                starts = np.cumsum(n) - n
                docs -= np.repeat(docs[starts] - steps[starts], n)
                sums = np.zeros((2, int(docs.max()) + 1), np.int64)
                np.add.at(sums[0], docs, times * best[place])
                np.add.at(sums[1], docs, times * counts[place])
                some = np.flatnonzero(sums[1])
                added = packed(np.diff(some, prepend=0), *sums[:, some])
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([added], pa.binary())], names=["run", "added"])

    return met.mapInArrow(add, "run long, added binary")


def _summed(contributions: DataFrame) -> DataFrame:
    """``(row, n_best, count_sum)`` of all documents with links; a run has as many contributions as parts, at most."""

    def run(table: pa.Table) -> pa.Table:
        held = [unpacked(a, 3) for a in table["added"].to_pylist()]
        docs = [np.cumsum(h[0]) for h in held]
        sums = np.zeros((2, max(int(d[-1]) for d in docs) + 1), np.int64)
        for at, (_, best, counts) in zip(docs, held):
            sums[0, at] += best
            sums[1, at] += counts
        some = np.flatnonzero(sums[1])
        return pa.table([pa.array(some + table["run"][0].as_py()), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["row", "n_best", "count_sum"])

    return contributions.groupBy("run").applyInArrow(run, "row long, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every document.

    Side A, a byte-level vocabulary, reads a space and the text; side B, a sentencepiece model, adds
    the space itself. Groups end where tokens of both sides do. Links are all pairs of tokens whose bytes
    overlap; the count of an id pair is the number of documents (rows, repeated ones too) that hold it linked;
    ``n_best`` links have the highest count of their A id, ties included. Null and empty texts, and those
    that either side does not give back byte by byte, have zeros and an empty digest. Null and
    repeated ids are rows like others; further columns are ignored; an empty table gives no rows.
    Texts are read whole: a task holds one text's tokens.
    """
    size_b = len(Pieces(b_path).bytes)
    table = _spilled(docs, a_path, b_path, id_col, text_col)
    runs = table.where(F.col("radix").isNotNull()).select("radix", "run", "heads", "records")
    added = _summed(_contributions(runs, pair_counts(runs.select("radix", "run", "heads"), size_b)))
    rows = table.where(F.col("row").isNotNull()).join(added, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
