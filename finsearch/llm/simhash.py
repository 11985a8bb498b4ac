"""SimHash fingerprints and links between them within a few bits, by a generalised pigeonhole.

The 64 bits are grouped into parts, correlated bits together, and part i gets its own threshold
T_i >= -1 with sum(T_i) = distance - parts + 1: two fingerprints within the distance are within T_i
on some part i. Number of parts and thresholds are those with the least estimated cost, found by
dynamic programming over estimated candidate counts. A part is probed by its value with every
choice of T_i bits masked; what meets under one probe is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsearch.llm.common import text_of
from finsearch.llm.components import connected
from finsearch.session import written

BITS = 64
SEED = 42
BUCKET = 16_384  # larger probe groups are linked through their balls instead of pairwise distances
PROBE_COST, VERIFY_COST = 1e-6, 1e-8  # seconds for a row that is shuffled, and for a pair that is compared


def simhash(text: bytes, shingle: int) -> int:
    """The fingerprint of a text in UTF-8, as a signed long: majority of each bit over all shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        octets = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int, keys: list[str], text_col: str = "text") -> DataFrame:
    """``(keys, fingerprint long)`` of whole texts; a null text counts as empty, with fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            prints = pa.array([simhash(t.encode(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], prints], names=[*keys, "fingerprint"])

    source = docs.select(*keys, text_of(text_col).alias("_text"))
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{kinds}, fingerprint long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set: sums over all rows, 64 x 64 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            octets = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            rows += len(bits)
        cells = [*both.astype(np.int64).ravel().tolist(), rows]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.int64())], names=["cell", "n"])

    cells = prints.select("fingerprint").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = {r["cell"]: r["n"] for r in cells.collect()}
    grid = np.array([found.get(i, 0) for i in range(BITS * BITS)], dtype=np.float64)
    return found.get(BITS * BITS, 0), grid.reshape(BITS, BITS)


def grouped_bits(rows: int, both: np.ndarray) -> list[int]:
    """All bits in an order in which correlated ones are neighbours: each next bit is the one closest to those before it."""
    share = both / max(rows, 1)
    ones = np.diag(share)
    spread = np.sqrt(ones * (1 - ones))
    scale = np.outer(spread, spread)
    tie = np.abs(np.divide(share - np.outer(ones, ones), scale, out=np.zeros_like(share), where=scale > 0))
    np.fill_diagonal(tie, 0)
    order = [int(np.argmax(tie.sum(axis=0)))]
    while len(order) < BITS:
        near = tie[order[-8:]].mean(axis=0)
        near[order] = -1
        order.append(int(np.argmax(near)))
    return order


def expected_pairs(rows: int, both: np.ndarray, bits: list[int], threshold: int) -> float:
    """Estimated pairs of fingerprints within a threshold on some bits, from the joint counts of those bits."""
    share = both[np.ix_(bits, bits)] / max(rows, 1)
    ones = np.diag(share)
    only = ones[:, None] - share
    neither = 1 - ones[:, None] - ones[None, :] + share
    differ = 2 * (share * neither + only * only.T)  # chance that two rows differ on both bits
    single = 2 * ones * (1 - ones)
    np.fill_diagonal(differ, single)
    mean, var = float(single.sum()), float((differ - np.outer(single, single)).sum())
    if mean <= 0:
        return rows * (rows - 1) / 2
    p = min(max(1 - var / mean, 1 / (4 * len(bits))), 1 - 1e-6)  # a binomial with this mean and spread
    n = max(mean / p, mean + 1e-6, threshold)
    p = mean / n
    chance = sum(
        exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)) for k in range(threshold + 1)
    )
    return rows * (rows - 1) / 2 * min(chance, 1.0)


def plan_probes(rows: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, of the least estimated cost; parts with threshold -1 are left out."""
    order = grouped_bits(rows, both)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(1, distance + 2):
        groups = [order[BITS * i // parts : BITS * (i + 1) // parts] for i in range(parts)]
        # table[s]: least cost of the parts so far with s + (number of parts) as sum of thresholds
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            longer: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, distance - spent + 1):
                    probes = comb(len(bits), t) if t >= 0 else 0
                    if probes > 4096:
                        continue
                    more = probes * rows * PROBE_COST + (expected_pairs(rows, both, bits, t) * VERIFY_COST if t >= 0 else 0)
                    key = spent + t + 1
                    if key not in longer or cost + more < longer[key][0]:
                        longer[key] = (cost + more, [*chosen, t])
            table = longer
        found = table.get(distance + 1)  # sum of (T_i + 1) = distance + 1
        if found and (best is None or found[0] < best[0]):
            best = (found[0], [(g, t) for g, t in zip(groups, found[1]) if t >= 0])
    assert best is not None
    return best[1]


def _mask(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def probe_masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """The bits that two fingerprints share under each probe."""
    return sorted({_mask(set(bits) - set(out)) for bits, t in parts for out in combinations(bits, t)})


def bucket_links(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """``(a, b)``: every fingerprint that some other is within the distance of, with the smallest it is connected to here."""
    prints = np.unique(prints)
    bits = prints.view(np.uint64)  # signed numbers would be counted by their absolute value
    n = len(prints)
    label = np.arange(n)
    if n <= 512:
        near = np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance, 1)
        left, right = np.nonzero(near)
        while True:  # all links at once: the smaller label wins until nothing changes
            low = np.minimum(label[left], label[right])
            if (label[left] == low).all() and (label[right] == low).all():
                break
            np.minimum.at(label, left, low)
            np.minimum.at(label, right, low)
            label = label[label]
    else:
        rest = np.arange(n)
        while len(rest):
            seed, rest = rest[0], rest[1:]
            edge = [seed]
            while edge and len(rest):
                at = edge.pop()
                hit = np.bitwise_count(bits[rest] ^ bits[at]) <= distance
                if hit.any():
                    label[rest[hit]] = seed
                    edge.extend(rest[hit])
                    rest = rest[~hit]
    linked = label != np.arange(n)
    return prints[linked], prints[label[linked]]


def _links_of_runs(distance: int):
    """Rows sorted by (mask, value): links inside every run. Runs may cross batches; none is longer than ``BUCKET``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            mask, value, prints = columns
            if not len(mask):
                return empty
            cuts = np.nonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))[0] + 1
            found = [bucket_links(p, distance) for p in np.split(prints, cuts) if len(p) > 1]
            if not found:
                return empty
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new)]
            mask, value, _ = held
            last = int(np.argmax((mask == mask[-1]) & (value == value[-1]))) if len(mask) else 0
            if last:
                yield links([c[:last] for c in held])
                held = [c[last:] for c in held]
        yield links(held)

    return run


def _ball_rows(distance: int):
    """Every fingerprint with the centres within half the distance, on the bits its probe leaves free.

    Two fingerprints that agree on the mask are within an even distance exactly if they share a centre.
    """
    radius = distance // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips: dict[int, np.ndarray] = {}
        for batch in batches:
            mask, _, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for m, p in zip(mask.tolist(), prints.tolist()):
                if m not in flips:
                    free = [b for b in range(BITS) if not m >> b & 1]
                    flips[m] = np.array([_mask(c) for r in range(radius + 1) for c in combinations(free, r)], dtype=np.int64)
                centres = flips[m] ^ np.int64(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(centres), m)), pa.array(centres), pa.array(np.full(len(centres), p))],
                    names=["mask", "centre", "fingerprint"],
                )

    return run


def links(prints: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links that connect all distinct ``fingerprint``s within ``distance`` bits, and no others.

    Links between fingerprints that are connected anyway may be left out: a probe group gives one
    link per member at most, so a group of near copies never becomes all its pairs. Probe groups
    over ``bucket`` rows are linked through shared centres, a row per member and centre, spread
    over the cluster. For an odd distance the centres find one bit more, and the members are verified.
    """
    rows, both = bit_counts(prints)
    masks = probe_masks(plan_probes(rows, both, distance))
    probes = F.array(*[F.lit(m).cast("long") for m in masks])
    keyed = prints.select("fingerprint", F.explode(probes).alias("mask")).select(
        "mask", F.col("mask").bitwiseAND(F.col("fingerprint")).alias("value"), "fingerprint"
    )
    sizes = keyed.groupBy("mask", "value").count().where("count > 1")
    met = keyed.join(sizes, ["mask", "value"])
    found = (
        met.where(F.col("count") <= bucket)
        .select("mask", "value", "fingerprint")
        .repartition("mask", "value")
        .sortWithinPartitions("mask", "value")
        .mapInArrow(_links_of_runs(distance), "a long, b long")
    )
    crowded = met.where(F.col("count") > bucket).select("mask", "value", "fingerprint")
    balls = crowded.mapInArrow(_ball_rows(distance + distance % 2), "mask long, centre long, fingerprint long")
    if distance % 2:  # members of a ball of the next even distance may be one bit too far: compare them in the ball
        near = balls.repartition("mask", "centre").sortWithinPartitions("mask", "centre")
        stars = near.mapInArrow(_links_of_runs(distance), "a long, b long")
    else:
        least = balls.groupBy("mask", "centre").agg(F.min("fingerprint").alias("b"))
        stars = balls.join(least, ["mask", "centre"]).where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")
    return found.unionByName(stars.distinct())


def components(docs: DataFrame, shingle: int, distance: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint long, component_id)`` for every row.

    ``component_id`` is the smallest id that links of at most ``distance`` differing bits lead to. Null and
    empty texts have fingerprint zero and link like others; null ids never name a component unless
    all its ids are null; repeated rows give a row each. Equal fingerprints become one before any
    search, so copies cost one row in it.
    """
    prints = written(fingerprints(docs.select(id_col, text_col), shingle, [id_col], text_col), "fingerprints")
    return prints.join(component_of(prints, distance, id_col), "fingerprint", "left").select(id_col, "fingerprint", "component_id")


def component_of(prints: DataFrame, distance: int, id_col: str) -> DataFrame:
    """``(fingerprint, component_id)`` of every distinct fingerprint in ``prints(fingerprint, id)``."""
    distinct = written(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    labels = connected(links(distinct.select("fingerprint"), distance))
    known = distinct.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("label", "fingerprint").alias("label")
    )
    ids = known.groupBy("label").agg(F.min("least").alias("component_id"))
    return known.join(ids, "label").select("fingerprint", "component_id")


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def representatives(docs: DataFrame, shingle: int, distance: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, with all its columns: the one with the smallest id.

    Null ids come last; of equal ids the text with the smaller hash stays, of repeated rows one.
    """
    key, text_hash = "_key", F.xxhash64(text_of(text_col))
    named = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), text_hash.cast("string"))
    keyed = docs.select(F.col(id_col), F.col(text_col), named.alias(key))
    prints = written(fingerprints(keyed, shingle, [id_col, key], text_col), "fingerprints")
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("key"))
    least = prints.groupBy("fingerprint").agg(F.min(rank).alias("least"))
    of = component_of(least, distance, "least").select(F.col("component_id.key").alias(key)).distinct()
    # the semi-join leaves the rows of a key together
    return docs.withColumn(key, named).join(of, key, "left_semi").dropDuplicates([key]).drop(key)
